"""Vocabularies, patterns and weights that fix the results of the classifiers.

Fixed values: these must be as they are for results to agree. They are data, grouped by operator.
"""

# Validation of documents and chunks
SOURCE_TYPES = ["pubmed", "icmr", "nmc", "mohfw", "state_guideline", "cochrane", "who", "cdc", "nih", "statpearls"]
TITLE_LEAST, DOC_LEAST, DOC_MOST, CHUNK_LEAST, CHUNK_MOST, GARBLE_MOST, LETTERS_LEAST = 5, 200, 2_000_000, 80, 8_000, 0.25, 0.4

# Document type, evidence level and boosts
SYSTEMATIC = ["systematic review", "meta-analysis", "meta analysis", "cochrane"]
GUIDELINE = ["guideline", "recommendation", "consensus", "protocol", "standard of care"]
TRIAL = ["randomized", "randomised", "randomization", "randomisation", "controlled trial", "rct"]
COHORT = ["cohort", "prospective", "retrospective", "longitudinal", "follow-up"]
CASE = ["case report", "case series"]
EDITORIAL = ["editorial", "commentary", "perspective", "opinion"]
LEVEL_OF_TYPE = {"meta_analysis": "1a", "systematic_review": "1a", "rct": "1b", "cohort": "2b", "guideline": "5", "review": "5", "case_report": "4", "editorial": "5", "unknown": "unknown"}
BOOST_OF_LEVEL = {"1a": 1.35, "1b": 1.25, "2a": 1.15, "2b": 1.10, "3": 1.05, "4": 1.00, "5": 1.10}
BOOST_OF_YEAR = {2025: 1.10, 2024: 1.08, 2023: 1.05, 2022: 1.03}
LABEL_OF_LEVEL = {
    "1a": "Systematic Review / Meta-Analysis", "1b": "Randomised Controlled Trial", "2a": "Systematic Review of Cohort Studies",
    "2b": "Cohort Study", "3": "Case-Control Study", "4": "Case Series", "5": "Expert Opinion / Guideline",
}
NO_LABEL = "Not Classified"

# Study type by pattern, in order: (pattern, type, level)
STUDY_TYPES = [
    (r"\b(?:meta.analysis|systematic review|cochrane)\b", "meta_analysis", 1),
    (r"\b(?:randomized|randomised|clinical trial|controlled trial)\b", "rct", 1),
    (r"\b(?:cohort study|case.control|prospective|retrospective study)\b", "observational", 2),
    (r"\b(?:guideline|recommendation|protocol)\b", "guideline", 2),
    (r"\b(?:review article|narrative review|literature review)\b", "review", 3),
    (r"\b(?:case report|case series|case study)\b", "case_report", 4),
]

# Content type
NOISE_SIGNS = [
    r"\breferences?\b", r"\backnowledgements?\b", r"\bforeword\b", r"\bcommittee members?\b", r"\btable of contents\b", r"\bindex\b", r"\bcopyright\b",
    r"\ball rights reserved\b", r"\bissn\b", r"\bdoi:\s*10\.", r"\bfigure \d+\b", r"\btable \d+\b", r"\bappendix\b",
]
CLINICAL_SIGNS = [
    r"\b(?:dosage|dose|mg|mcg|kg|treatment|therapy|antibiotic|drug|prescri)\b",
    r"\b(?:patient|physician|doctor|hospital|clinic|ward)\b",
    r"\b(?:diagnosis|diagnostic|symptom|sign|fever|pain|infection)\b",
    r"\b(?:guideline|protocol|recommendation|management|should|must)\b",
    r"\b(?:oral|intravenous|subcutaneous|intramuscular)\b",
]
PRECLINICAL_SIGNS = [r"\b(?:mouse|rat|animal model|in vivo)\b", r"\b(?:in vitro|cell line|cell culture|primary cells)\b", r"\b(?:assay|mechanism|pathway|molecular target)\b"]
SECTION_NOISE = ["reference", "acknowledgement", "foreword", "appendix", "index"]
SECTION_BACKGROUND = ["abstract", "introduction", "background", "history", "epidemiology"]
SECTION_PRECLINICAL = ["method", "animal", "in vitro", "mouse", "rat model"]
SECTION_CLINICAL = ["treatment", "management", "dosage", "dose", "therapy", "diagnosis", "protocol", "guideline", "recommendation", "drug", "antibiotic", "clinical", "patient"]
WEIGHT_OF_CONTENT = {"clinical": 1.5, "preclinical": 1.0, "background": 0.7, "noise": 0.1}

# Chunk quality
BASE_OF_CONTENT = {"clinical": 0.80, "preclinical": 0.55, "background": 0.40, "noise": 0.05}
BASE_UNKNOWN = 0.35
BONUS_OF_LEVEL = {1: 0.15, 2: 0.10, 3: 0.05, 4: 0.0, 5: -0.05}
HIGH_VALUE = [
    r"\b(?:dosage|dose|mg|mcg|g)\b", r"\b(?:treatment|therapy|management|protocol|guideline|recommendation)\b", r"\b(?:contraindicated?|adverse|warning|caution)\b",
    r"\b(?:rct|randomized|randomised|systematic review|meta.analysis)\b", r"\b(?:first.line|second.line|alternative|empirical|prophylaxis)\b",
]
LOW_VALUE = [r"(?m)^\s*\d+\s*$", r"\b(?:et al\.|ibid\.|op cit\.)\b", r"(?m)^(?:figure|table|box|appendix)\s+\d+", r"https?://\S+"]
QUALITY_GATE = 0.3

# Specialties, relevance, dosing and laboratory flags
SPECIALTIES = {
    "cardiology": ["cardiac", "heart", "coronary", "myocardial", "arrhythmia", "hypertension"],
    "endocrinology": ["diabetes", "insulin", "thyroid", "hormone", "hba1c", "glycemic"],
    "pulmonology": ["asthma", "copd", "lung", "respiratory", "pneumonia", "tuberculosis"],
    "neurology": ["stroke", "seizure", "epilepsy", "neuro", "dementia", "parkinson"],
    "infectious_disease": ["infection", "antibiotic", "viral", "bacterial", "dengue", "malaria"],
    "gastroenterology": ["liver", "hepatitis", "gastric", "pancreas", "ibd", "colitis"],
    "oncology": ["cancer", "tumor", "tumour", "carcinoma", "neoplasm", "chemotherapy"],
    "nephrology": ["kidney", "renal", "creatinine", "dialysis", "gfr", "nephritis"],
}
INDIA_WORDS = ["india", "indian", "icmr", "nmc", "aiims", "pgimer", "jipmer", "rssdi", "cardiological society of india", "japi", "nmj", "ijmr"]
INDIA_DATA = ["indian patients", "patients in india", "india", "new delhi", "mumbai"]
INDIA_SOURCES = ["icmr", "nmc_guideline", "rssdi", "who_india"]
INDIA_JOURNALS = ["japi", "journal of association of physicians of india", "ijmr", "indian heart journal", "journal of indian medical association"]
DOSING = ["mg/kg", "mg/day", "mg twice", "mg once", "units/kg", "tablet", "capsule", "dose", "dosage", "titrat", "po bid", "i.v.", "p.o."]
LABS = ["reference range", "normal range", "hba1c", "serum creatinine", "mg/dl", "mmol/l", "hemoglobin", "platelet", "wbc", "ldl", "hdl", "egfr"]
TAG_NOISE = ["india", "treatment", "management", "clinical", "study"]

# Entities
DRUGS = r"\b(?:doxycycline|azithromycin|rifampicin|isoniazid|pyrazinamide|ethambutol|streptomycin|amoxicillin|ciprofloxacin|metronidazole|fluconazole|amphotericin|artemisinin|chloroquine|primaquine|oseltamivir|acyclovir|cotrimoxazole|paracetamol|ibuprofen|aspirin|metformin|insulin|amlodipine|atenolol|enalapril|losartan|furosemide|spironolactone|digoxin|warfarin|heparin|vancomycin|linezolid|meropenem|ceftriaxone|piperacillin|tazobactam|amikacin|gentamicin|colistin|tigecycline|daptomycin|clindamycin|hydroxychloroquine|remdesivir|dexamethasone|methylprednisolone|prednisolone|omeprazole|pantoprazole|ranitidine|ondansetron|metoclopramide|clopidogrel|atorvastatin|rosuvastatin|simvastatin|nifedipine|propranolol|metoprolol|bisoprolol|ramipril|lisinopril|valsartan|levodopa|carbidopa|donepezil|memantine|haloperidol|risperidone|olanzapine|sertraline|fluoxetine|paroxetine|escitalopram|amitriptyline|nortriptyline|carbamazepine|phenytoin|valproate|lamotrigine|levetiracetam|morphine|fentanyl|tramadol|codeine|oxycodone|naloxone|buprenorphine|salbutamol|ipratropium|tiotropium|budesonide|fluticasone|montelukast|methotrexate|sulfasalazine|adalimumab|infliximab|rituximab|bevacizumab|trastuzumab|imatinib|erlotinib|sorafenib)\b"
DISEASES = r"\b(?:tuberculosis|tb|malaria|dengue|typhoid|leptospirosis|scrub typhus|rickettsial|covid-19|sars-cov-2|pneumonia|sepsis|meningitis|encephalitis|hepatitis|cirrhosis|diabetes|hypertension|heart failure|myocardial infarction|stroke|asthma|copd|chronic kidney disease|ckd|anaemia|anemia|cholera|chikungunya|japanese encephalitis|rabies|snakebite|mucormycosis|influenza|hiv|aids|malignancy|cancer|carcinoma|lymphoma|leukemia|alzheimer|parkinson|epilepsy|schizophrenia|bipolar disorder|depression|anxiety disorder|ptsd|autism|adhd|hypothyroidism|hyperthyroidism|rheumatoid arthritis|lupus|psoriasis|crohn|ulcerative colitis|osteoporosis|osteoarthritis|gout|ankylosing spondylitis|acute kidney injury|aki|chronic liver disease|fatty liver|nafld|pulmonary embolism|deep vein thrombosis|dvt|atrial fibrillation|acute coronary syndrome|acs|unstable angina|stemi|nstemi)\b"
DOSAGES = [
    r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|meq|mmol|iu|units?)\b(?:\s*/\s*(?:kg|m2|day|dose|hour|week))?",
    r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|g)\s*(?:twice|thrice|once|three times?|four times?)\s*(?:daily|a day|per day)\b",
    r"\b(?:once|twice|thrice|three times?)\s*(?:daily|a day|weekly|per week)\b",
    r"\b(?:bd|tds|qid|od|qds|prn|sos|nocte|mane)\b",
]
CONTRAINDICATIONS = r"\b(?:contraindicated?|avoid(?:ed|ing)?\s+in|not\s+(?:recommended|used?|given?)\s+in|should\s+not\s+(?:be\s+)?used?|do\s+not\s+(?:use|administer)|caution\s+in|use\s+with\s+caution)\b"
SAFETY = r"\b(?:warning|caution|alert|black.?box|serious\s+adverse|life.?threatening|fatal|death|toxicity|overdose|anaphylaxis|anaphylactic|hypersensitivity|severe\s+reaction|qt\s*prolongation|nephrotoxic|hepatotoxic|cardiotoxic|neurotoxic|teratogenic|pregnancy\s*category\s*[dx]|fetal\s+(?:harm|risk)|renal\s+failure|liver\s+failure|bone\s+marrow\s+suppression)\b"
POPULATIONS = r"\b(?:paediatric|pediatric|child(?:ren)?|infant|neonat(?:e|al)|adult|elderly|geriatric|older\s+adults?|pregnant|pregnancy|lactating|breastfeeding|immunocompromised|immunodeficient|hiv.positive|renal(?:\s+impairment)?|hepatic(?:\s+impairment)?|diabetic|hypertensive|obese|underweight)\b"
OUTCOMES = r"\b(?:mortality|morbidity|survival|cure\s+rate|response\s+rate|remission|relapse|recurrence|hospitalization|readmission|adverse\s+(?:event|effect|reaction)|side\s+effect|quality\s+of\s+life|qol|clinical\s+outcome|resolution|recovery|improvement|deterioration|progression)\b"

# Tokens of the sparse index
COMPOUNDS = [
    "type 2 diabetes", "type 1 diabetes", "heart failure", "blood pressure", "myocardial infarction", "atrial fibrillation", "blood glucose", "hemoglobin a1c", "hba1c",
    "randomized controlled trial", "systematic review", "meta analysis", "meta-analysis", "insulin resistance", "glycemic control", "renal failure", "coronary artery disease", "coronary heart disease",
]
STOP_WORDS = "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might shall this that these those it its we our they their as if than more most such".split()
BUCKETS, LEGACY_BUCKETS = 50_000, 2_000_000

# Queries: intent, expansion, rewriting, routing, decomposition
INTENTS = {
    "diagnostic": ["what causes", "cause of", "differential", "how to diagnose", "symptoms of", "signs of", "what is", "aetiology"],
    "therapeutic": ["treatment", "treat", "therapy", "management", "drug of choice", "dose", "dosage", "first line", "medication for"],
    "prognostic": ["prognosis", "outcome", "survival", "mortality", "risk of"],
    "drug_info": ["side effects", "adverse effects", "interactions", "contraindications", "mechanism of"],
    "guideline": ["guideline", "recommendation", "protocol", "standard of care", "icmr"],
}
SYNONYMS = {
    "heart attack": ["myocardial infarction", "mi", "acute coronary syndrome"],
    "diabetes": ["diabetes mellitus", "dm", "type 2 diabetes", "t2dm"],
    "high blood pressure": ["hypertension", "htn"],
    "stroke": ["cerebrovascular accident", "cva"],
    "tb": ["tuberculosis", "mycobacterium tuberculosis"],
    "dengue": ["dengue fever", "dengue hemorrhagic fever"],
}
RECENT, GUIDED, INDIAN, DOSED = ["recent", "latest", "current", "2024", "2025"], ["guideline", "recommendation", "protocol"], ["india", "indian", "indians"], ["dose", "dosage"]
REWRITE_INTENTS = {
    "therapeutic": ["treatment", "therapy", "drug", "dose", "medication"],
    "diagnostic": ["diagnose", "symptom", "cause", "differential"],
    "prognostic": ["prognosis", "outcome", "survival", "mortality"],
    "drug_info": ["side effect", "interaction", "contraindication"],
    "guideline": ["guideline", "recommendation", "protocol", "icmr"],
}
ABBREVIATIONS = {
    "htn": "hypertension", "dm": "diabetes mellitus", "mi": "myocardial infarction", "tb": "tuberculosis", "copd": "chronic obstructive pulmonary disease",
    "cad": "coronary artery disease", "cva": "cerebrovascular accident", "chf": "congestive heart failure", "afib": "atrial fibrillation", "dka": "diabetic ketoacidosis",
}
ROUTE_PATTERNS = [
    r"\bvs\b|\bversus\b|\bcompared to\b", r"\binteract(?:ion|ing|s)?\b", r"\bwith\b.*\b(medication|drug|pill)\b",
    r"\b(and|with)\b.*\b(diabetes|hypertension|ckd|copd|chf)\b.*\b(and|with)\b", r"\bcontraindicat(?:ed|ion|ions)\b", r"\bdifferential\b", r"\bwhat could cause\b",
    r"\bprotocol\b.*\bversus\b", r"\bguideline\b.*\bconflic", r"\bmonitor\b.*\band\b", r"\bmanage\b.*\bcomorbidi", r"\bside effect\b.*\binteract", r"\badverse\b.*\bcombination\b",
]
ROUTE_COMPARING = [0, 7]  # patterns that ask for a comparison
ROUTE_TERMS = "diabetes hypertension ckd copd chf cad mi stroke asthma arthritis cancer tb dengue malaria fever pain infection metformin insulin atorvastatin amlodipine paracetamol ibuprofen aspirin warfarin".split()
ROUTE_ADVICE = ["should i", "can i", "is it safe"]
ROUTE_INTENTS = {
    "diagnostic": ["diagnos", "symptom", "cause", "differential", "etiology"],
    "therapeutic": ["treat", "therapy", "management", "drug", "medication", "dose"],
    "drug_info": ["interact", "contraind", "side effect", "adverse", "mechanism"],
    "prognostic": ["prognos", "outcome", "survival", "mortality", "risk"],
    "guideline": ["guideline", "recommend", "protocol", "standard"],
    "comparative": ["versus", "vs", "compare", "better", "difference"],
}
ROUTE_ASPECTS = {
    "diagnostic": ["diagnosis", "symptoms", "differential", "etiology"],
    "therapeutic": ["treatment", "drug_of_choice", "dosage", "regimen"],
    "drug_info": ["interactions", "contraindications", "side_effects", "mechanism"],
    "prognostic": ["prognosis", "outcome", "mortality", "survival"],
    "guideline": ["guidelines", "recommendations", "protocols", "standards"],
    "comparative": ["comparison", "versus", "which_is_better", "efficacy"],
}
ROUTE_DISEASES = "diabetes hypertension asthma copd ckd chf cad mi stroke tb dengue cancer arthritis thyroid anemia".split()
ROUTE_DRUGS = "metformin insulin glipizide atorvastatin amlodipine losartan paracetamol ibuprofen aspirin warfarin metoprolol omeprazole".split()
QUERY_ENTITIES = [("disease", "diabetes"), ("disease", "hypertension"), ("drug", "metformin")]
SUB_QUERIES = [  # id, text before the query, focus, priority, source, words that call for it (none: always)
    ("q1", "treatment options for ", "treatment", 1, None, ["treatment"]),
    ("q2", "recommended drug dosages for ", "dosage", 2, None, ["treatment"]),
    ("q3", "drug interactions for ", "interactions", 1, None, ["interact", "with"]),
    ("q4", "contraindications for ", "contraindications", 1, None, ["contraind", "safe"]),
    ("q5", "ICMR guidelines for ", "guidelines", 2, "icmr", []),
    ("q6", "latest research on ", "research", 3, "pubmed", []),
]

# Contradictions: (kind, one word, the opposite)
OPPOSITES = [
    ("treatment_conflict", "first line", "second line"), ("treatment_conflict", "recommended", "not recommended"), ("treatment_conflict", "contraindicated", "indicated"),
    ("treatment_conflict", "improve", "worsen"), ("dosage_conflict", "mg", "mcg"), ("dosage_conflict", "once daily", "twice daily"), ("dosage_conflict", "increase", "decrease"),
    ("outcome_conflict", "effective", "ineffective"), ("outcome_conflict", "beneficial", "harmful"), ("outcome_conflict", "safe", "unsafe"),
]

# Checks of answers
TRUSTED = {"cochrane": 5, "who": 5, "nice": 5, "pubmed": 4, "icmr": 4, "cdc": 4, "statpearls": 3, "medline": 3, "uptodate": 3}
OLD_YEARS = 5
DOSE_NUMBER, PERCENT_NUMBER, TIME_NUMBER = r"\b(\d+(?:\.\d+)?)\s*(?:mg|g|kg|mcg|ml|iu|units?)\b", r"\b(\d+(?:\.\d+)?)\s*%", r"\b(\d+)\s*(?:days?|weeks?|months?|years?|hours?)\b"
DRUG_ENDINGS = ["mycin", "cillin", "azole", "pril", "sartan", "statin", "mab", "nib", "vir"]
ANSWER_SHORT_FORMS = ["Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "etc.", "vs.", "mg.", "kg.", "approx."]
WARNINGS = [  # type, severity, patterns
    ("TREATMENT_RECOMMENDATION", "MEDIUM", [r"\bshould\s+(be\s+)?(?:treat|give|administer|prescribe)", r"\brecommend(?:ed|s)?\s+(?:to\s+)?(?:treat|give|administer|use)", r"\btreat(?:ed|ment)?\s+with\b", r"\badminister(?:ed|ing)?\s+", r"\bprescribe(?:d|s)?\s+", r"\bfirst[- ]?line\s+(?:treatment|therapy|drug)", r"\bgiven?\s+(?:the\s+)?patient"]),
    ("DOSAGE_INFO", "MEDIUM", [r"\b(\d+(?:\.\d+)?)\s*(?:mg|g|kg|mcg|ml|iu|units?)/(?:kg|day|dose)", r"\b(\d+(?:\.\d+)?)\s*(?:mg|g|kg|mcg|ml|iu|units?)\s+(?:once|twice|three times|daily|weekly|monthly)", r"dose\s+of\s+(\d+(?:\.\d+)?)\s*(?:mg|g|kg|mcg)", r"\b(\d+)\s*(?:tablets?|capsules?|pills?)\s+(?:daily|per day|twice daily)"]),
    ("CONTRAINDICATION", "LOW", [r"\bcontraindicated\s+(?:in|for|with)", r"\bshould\s+(?:not|never)\s+(?:be\s+)?(?:used|given|administered)", r"\bavoid(?:ed|ing)?\s+(?:in|during|with)", r"\bnot\s+recommended\s+(?:for|in|during)", r"\bdo\s+not\s+(?:use|give|administer)"]),
    ("DRUG_INTERACTION", "MEDIUM", [r"\binteracts?\s+with\b", r"\bdrug[- ]?drug\s+interaction", r"\bwhen\s+(?:taken|used|combined)\s+with\b", r"\bconcomitant(?:ly)?\s+(?:use|administration)\s+(?:of|with)", r"\bshould\s+not\s+be\s+(?:taken|used|combined)\s+with", r"\bavoid\s+(?:concurrent|concomitant|simultaneous)"]),
    ("MONITORING_REQUIRED", "LOW", [r"\bmonitor(?:ing|ed)?\s+(?:for|of|closely|regularly)", r"\brequires?\s+(?:regular|close|careful)\s+monitoring", r"\bcheck\s+(?:liver|kidney|renal|hepatic|blood|cardiac|ecg)", r"\bperiodic\s+(?:monitoring|testing|checks)", r"\bbaseline\s+(?:and\s+)?(?:periodic|regular)\s+(?:tests?|monitoring)"]),
    ("OFF_LABEL_USE", "MEDIUM", [r"\boff[- ]?label\s+(?:use|indication)", r"\bnot\s+(?:fda[- ]?)?approved\s+(?:for|in)", r"\bunapproved\s+(?:use|indication)"]),
]
DANGEROUS = [("warfarin", "aspirin"), ("methotrexate", "nsaid"), ("lithium", "nsaid"), ("digoxin", "amiodarone"), ("simvastatin", "gemfibrozil"), ("maoi", "ssri"), ("linezolid", "ssri")]
MONITORED = "linezolid bedaquiline delamanid clofazimine aminoglycosides amikacin kanamycin streptomycin capreomycin cycloserine ethionamide isoniazid rifampicin pyrazinamide fluoroquinolones methotrexate warfarin lithium digoxin vancomycin".split()

# Chunking
HEADER = r"^(?:\d+\.\s*)?(abstract|introduction|background|methods?|materials and methods|results|discussion|conclusion|conclusions)\s*$"
TARGET_TOKENS, MOST_TOKENS, LEAST_TOKENS, OVERLAP_TOKENS, TABLES_MOST, ROWS_MOST = 350, 500, 80, 50, 20, 20
SHORT_FORMS = ["et al.", "fig.", "e.g.", "i.e.", "vs.", "p.o.", "i.v."]
RRF_K, FUSED_TOP, HITS_TOP, RERANK_TOP, MMR_TOP, MMR_LAMBDA, CONTEXT_CHARS = 60, 20, 50, 8, 6, 0.7, 12_000

#: Hits a synthesis is given, and citations it lists.
SYNTHESIS_MOST, CITED_MOST = 20, 10
