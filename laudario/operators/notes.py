"""Fixed values of line classification: notes that carry no result, by the start of their comparison key."""

# Fixed values: (rule, prefix of the comparison key, whether the note goes on to the footer), in order of evaluation.
NOTE_RULES = (
    ("dipyrone-interference", "NOTA: O USO DE DIPIRONA", False),
    ("idms-definition", "*IDMS: ISOTOPE DILUTION MASS SPECTROMETRY", False),
    ("antibiogram-legend", "LEGENDA: S - SENSIVEL I - INTERMEDIARIO R - RESISTENTE", False),
    ("lipid-source", "FONTE: FALUDI AA, IZAR MCO, SARAIVA JFK", False),
    ("diabetes-source", "FONTE: SOCIEDADE BRASILEIRA DE DIABETES", False),
    ("hematology-bands", "AS CELULAS BASTONADAS ESTAO INCLUIDAS NA CONTAGEM DE NEUTROFILOS", False),
    ("hematology-red-reference-table", "VALORES HEMATOLOGICOS DE REFERENCIA - SERIE VERMELHA", True),
    ("hematology-adult-reference-table", "VALORES HEMATOLOGICOS DE REFERENCIA EM ADULTOS", True),
    ("hematology-adult-reference-scripts", "12 | 9 | CHCM | 9", False),
    ("hematology-adult-reference-header", "HEMACIAS (X10 /L) HEMOGLOBINA", False),
    ("hematology-adult-reference-unit", "(G/DL)", False),
    ("hematology-adult-reference-men", "HOMENS | 5,0", False),
    ("hematology-adult-reference-women", "MULHERES | 4,3", False),
    ("urinalysis-automation", "SEMI-AUTOMACAO (U500 -", False),
    ("urinalysis-microscopy", "COM MICROSCOPIA COMPLEMENTAR (FUS-2000 - DIRUI)", False),
    ("vitros-manufacturer", "(JOHNSON)", False),
    ("egfr-explanation", "NOTA: ESTIMADA POR CALCULO CONFORME O NATIONAL KIDNEY", False),
    ("methodology-change", "ATENCAO: NOVA METODOLOGIA", False),
    ("reference-change", "ATENCAO: NOVOS VALORES DE REFERENCIA", False),
    ("control-change", "NOTA: ATENCAO PARA MUDANCA DE VALOR DE CONTROLE", False),
    ("reference-date-change", "NOTA: ATENCAO PARA NOVO VALOR DE REFERENCIA", False),
    ("toxoplasmosis-general", "NOTA: EM CASOS DE RESULTADOS REAGENTES PARA IGM E IGG DA TOXOPLASMOSE", False),
    ("toxoplasmosis-sensitivity", "NOTA: PERCEBE-SE NA ROTINA LABORATORIAL QUE O METODO UTILIZADO", False),
    ("toxoplasmosis-igg-screening", 'NOTA 1: "AS AMOSTRAS COM CONCENTRACOES', False),
    ("toxoplasmosis-assay-comparison", 'NOTA 2: "OS RESULTADOS QUE SEGUEM FORAM OBTIDOS COM O ENSAIO ELECSYS TOXO IGG', False),
    ("toxoplasmosis-igg-igm-guidance", "NOTA 3: EM CASOS DE RESULTADOS REAGENTES PARA IGM E IGG DA TOXOPLASMOSE", False),
    ("toxoplasmosis-avidity-guidance", "NOTA: EM CASOS DE PRESENCA DE REATIVIDADE PAA IGG E IGM", False),
    ("toxoplasmosis-avidity-general", "NOTA 2: AVIDEZ BAIXA SUGERE INFECCAO RECENTE", False),
    ("toxoplasmosis-avidity-combination", "NOTA 3: ESTE EXAME DEVE SER AVALIADO CONJUNTAMENTE", False),
    ("toxoplasmosis-avidity-time", "NOTA 4: AVIDEZ PARA TOXOPLASMOSE", False),
    ("lipid-total-guidance", 'NOTA 1: "VALORES DE COLESTEROL TOTAL', False),
    ("lipid-risk-guidance", "NOTA 2: VALORES DE REFERENCIAIS E DE ALVO TERAPEUTICO", False),
    ("triglycerides-pediatric", "NOTA 1: CRIANCAS E ADOLESCENTES COM TRIGLICERIDEOS", False),
    ("triglycerides-repeat", "NOTA 2: QUANDO OS NIVEIS DE TRIGLICERIDES", False),
    ("ldl-pediatric", "NOTA: CRIANCAS E ADOLESCENTES COM LDL-C", False),
    ("non-hdl-calculation", "NOTA: O COLESTEROL NAO-HDL E CALCULADO", False),
    ("hba1c-diagnosis", "NOTA 1: O DIAGNOSTICO DE DIABETES MELLITUS", False),
    ("hba1c-method", "NOTA 2: O METODO UTILIZADO NESTA DOSAGEM DE HEMOGLOBINA GLICADA", False),
    ("hba1c-estimated-glucose", "NOTA 3: A GLICEMIA MEDIA ESTIMADA", False),
    ("hba1c-overflow-guidance", "EM CASOS DE RESULTADO SUPERIOR A 14%", False),
    ("hba1c-adag-source", "BASE NOS VALORES REFERENCIAIS DESTAS (THE A1C-DERIVED", False),
    ("hba1c-guidance", "NOTA 4: CONFORME A AMERICAN DIABETES ASSOCIATION", False),
    ("troponin-guidance", 'NOTA: "A LESAO DO MIOCARDIO', False),
    ("troponin-cutoff", "NOTA: UTILIZANDO COMO BASE OS CRITERIOS DA OMS", False),
    ("vdrl-guidance", "NOTA: A MAIOR IMPORTANCIA CLINICA NA REACAO DE VDRL", False),
    ("vdrl-source", 'NOTA: "ADPTADO DE: BRASIL, MINISTERIO DA SAUDE', False),
    ("hiv-confirmation", "NOTA: O DIAGNOSTICO SOROLOGICO DA INFECCAO PELO HIV", False),
    ("hcv-screening", "NOTA 1: O METODO DE EIE", False),
    ("hcv-confirmation", "NOTA 1: AMOSTRAS COM RESULTADOS REAGENTE DEVEM SER CONFIRMADAS", False),
    ("hcv-immunosuppression", "NOTA 2: PACIENTES IMUNOSSUPRIMIDOS", False),
    ("generic-confirmation", "NOTA: SUGERIMOS A REALIZACAO DE TESTE CONFIRMATORIO", False),
    ("psa-correlation", "NOTA: CORRELACIONAR COM O VALOR DE PSA TOTAL", False),
    ("dengue-negative", "NOTA: SE O RESULTADO FOR NAO REAGENTE E OS SINTOMAS PERSISTIREM", False),
    ("dengue-interpretation", "NOTA: OS RESULTADOS OBTIDOS COM ESSE TESTE", False),
    ("dengue-antigen-window", "NOTA: PODE OCORRER RESULTADO NEGATIVO QUANDO A QUANTIDADE DE ANTIGENOS DA DENGUE", False),
    ("dengue-exposure", "NOTA: A POSSIBILIDADE DE EXPOSICAO OU INFECCAO PELO VIRUS DA DENGUE", False),
    ("heterophile-interference", "NOTA: CONCENTRACOES ANORMALMENTE ELEVADAS DE ANTICORPOS HETEROFILOS", False),
    ("sars-quantification", "NOTA: O VALOR QUANTITATIVO OU A CONCENTRACAO DE ANTIGENOS DE SARS-COV-2", False),
    ("biotin-interference", "NOTA: O USO DE BIOTINA EXOGENA", False),
    ("macroproteinuria-interference", "NOTA: VALORES FALSAMENTE BAIXOS PODEM OCORRER EM PACIENTES COM MACROPROTEINURIA", False),
    ("generic-interpretation", "NOTA: OS RESULTADOS DEVEM SER INTERPRETADOS CONSIDERANDO-SE FATORES", False),
    ("ck-ratio", "NOTA: VALORES FORA DA FAIXA DE", False),
    ("support-laboratory", "NOTA 1: EXAME REALIZADO EM LABORATORIO DE APOIO", False),
    ("support-laboratory-forwarded", "NOTA: EXAME ENCAMINHADO", False),
    ("cmv-assay-comparison", 'OBSERVACAO: "OS RESULTADOS QUE SEGUEM FORAM OBTIDOS COM O ENSAIO ELECSYS CMV IGG', False),
    ("cutoff-magnitude", "OBSERVACAO: A MAGNITUDE DO RESULTADO DETERMINADO ACIMA DO CUTOFF", False),
)
# Fixed values: (rule, heading without its colon, prefix of the next line).
BLOCK_STARTS = (
    ("egfr-observations", "OBSERVACOES", "1. VALORES PERSISTENTES ABAIXO DE 60"),
    ("hiv-notes-block", "NOTAS", "- O DIAGNOSTICO SOROLOGICO DA INFECCAO PELO HIV"),
    ("assay-interference-block", "NOTAS", "- O USO DE BIOTINA EXOGENA"),
    ("psa-notes-block", "NOTAS", "- OS RESULTADOS DEVEM SER INTERPRETADOS CONSIDERANDO-SE FATORES COMO IDADE"),
    ("hcg-guidance-block", "NOTA", "A PRODUCAO DO HCG SE INICIA"),
)
FOOTER_START = "Laudo conferido e liberado eletronicamente"
FOOTER_REST = ("Responsável Técnico", "Data e hora", "Impresso por", "Este laudo possui")
