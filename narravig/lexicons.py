"""Default word lists. Results depend on exactly these words, in this order."""

# fixed values
DRUGS = (
    "tylenol", "acetaminophen", "lipitor", "atorvastatin", "amoxicillin", "ibuprofen", "advil", "motrin", "warfarin", "coumadin", "aspirin", "metformin",
    "lisinopril", "omeprazole", "metoprolol", "amlodipine", "albuterol", "prednisone", "gabapentin", "hydrocodone", "oxycodone", "morphine", "citalopram",
    "sertraline", "fluoxetine", "simvastatin", "levothyroxine", "azithromycin", "ciprofloxacin", "doxycycline", "penicillin", "cephalexin", "clindamycin",
    "vancomycin", "lorazepam", "diazepam", "alprazolam", "zolpidem", "quetiapine", "risperidone", "olanzapine", "haloperidol", "insulin", "methotrexate",
)

# fixed values; "liver damage" stands twice
REACTIONS = (
    "nausea", "vomiting", "diarrhea", "diarrhoea", "headache", "dizziness", "fatigue", "rash", "itching", "pruritus", "liver damage", "hepatotoxicity",
    "myalgia", "muscle weakness", "muscle pain", "elevated liver enzymes", "elevated alt", "elevated ast", "elevated ck", "jaundice", "abdominal pain",
    "chest pain", "shortness of breath", "dyspnea", "dyspnoea", "anaphylaxis", "urticaria", "angioedema", "stevens-johnson syndrome",
    "toxic epidermal necrolysis", "renal failure", "kidney failure", "seizure", "confusion", "hallucination", "insomnia", "depression", "anxiety",
    "palpitations", "tachycardia", "bradycardia", "hypertension", "hypotension", "bleeding", "bruising", "thrombosis", "stroke", "myocardial infarction",
    "heart attack", "back pain", "joint pain", "arthralgia", "swelling", "edema", "fever", "pyrexia", "chills", "night sweats", "weight gain", "weight loss",
    "hair loss", "alopecia", "blurred vision", "tinnitus", "hearing loss", "blistering", "mucosal involvement", "muscle spasm", "myopathy", "rhabdomyolysis",
    "pancreatitis", "peripheral neuropathy", "liver damage", "skin reddening", "stomach bleeding", "allergic reaction", "difficulty breathing",
    "serious skin reactions", "dark urine", "clay-colored stools", "loss of appetite", "upper stomach pain",
)

# fixed values; where two fit at one place the earlier counts
WARNING_HEADERS = (
    "Liver warning", "Allergy alert", "Do not use", "Ask a doctor before use", "Ask a doctor or pharmacist before use", "Stop use and ask a doctor",
    "Overdose warning", "Keep out of reach", "If pregnant or breast-feeding", "When using this product", "Sore throat warning", "Stomach bleeding warning",
    "Heart attack and stroke warning", "Warnings",
)

# fixed values
EXCLUDED_TERMS = (
    "off label use", "drug ineffective", "fall", "death", "product quality issue", "no adverse event", "condition aggravated",
    "therapeutic response decreased", "drug interaction", "medication error", "wrong drug administered", "incorrect dose administered",
    "drug administration error", "intentional overdose", "accidental overdose", "overdose", "product use issue",
    "inappropriate schedule of drug administration", "lack of efficacy", "weight increased", "weight decreased",
)

# fixed values
BOILERPLATE = (
    "to report", "contact ", "call ", "fda at ", "1-800", "www.", "postmarketing", "the following", "table ", "clinical trial", "in clinical",
    "adverse reactions reported", "because these reactions", "voluntarily reported", "cannot be reliably", "adverse reaction reporting", "were white",
    "were black", "were female", "were male", "were hispanic", "were asian", "% white", "% black", "% female", "% male", "% hispanic", "% asian",
    "median age", "mean age", "age range", "years of age", "patients were", "subjects were", "participants were", "n =", "n=", "placebo", "treatment group",
    "study population", "enrolled", "randomized", "double-blind", "open-label", "most common", "incidence of", "occurred in", "reported in", "observed in",
    "compared to", "compared with", "versus", "vs.", "per 100", "rate of", "frequency of", "proportion of", "off label", "off-label", "label use",
    "prescribing information", "see full", "full prescribing", "medication guide", "package insert", "see section", "refer to", "please see",
    "for more information", "not established", "not been established", "has not been", "have not been", "is not known", "are not known", "was not evaluated",
    "were not evaluated", "in patients with", "in patients who", "in subjects", "in healthy", "doses of", "dose of", "mg dose", "mg/day", "mg/kg",
    "once daily", "twice daily", "three times", "four times", "clinical study", "clinical studies", "controlled trial", "controlled study",
    "safety and efficacy", "efficacy and safety", "safety profile", "no clinically", "not clinically", "not statistically", "statistically significant",
    "spontaneous report", "post-market", "postmarket", "surveillance",
)

# fixed values; an item that starts with one of these as whole words is no reaction
LEADING = (
    "and", "or", "in", "of", "at", "to", "the", "a", "an", "with", "for", "by", "as", "on", "also", "respectively", "including", "such as", "following",
    "both", "either", "neither", "however", "therefore", "additionally", "furthermore", "moreover", "although", "whereas", "while", "since", "because",
    "compared", "between", "among", "during", "within", "after", "before", "above", "below", "these", "those", "this", "that", "which", "who", "than", "then",
    "when", "where", "upon", "if", "when", "should", "must", "do not", "do", "use", "take", "avoid", "monitor", "consider", "consult", "contact", "inform",
    "instruct", "advise", "recommend", "discontinu", "interrupt", "reduc", "increas", "adjust", "withhold", "resume", "administer", "prescri", "dispens",
    "store", "keep", "discard",
)
LEADING_WORDS = "|".join(LEADING)

# fixed values
NEGATED_BY = (
    "no", "not", "without", "denies", "denied", "deny", "absence of", "absent", "free of", "negative for", "never", "ruled out", "unremarkable for",
    "fails to", "did not", "does not", "was not", "were not", "is not", "are not",
)
NEGATIONS = "|".join(NEGATED_BY)
DOSE = r"\b(\d+\.?\d*\s*(?:mg|mcg|ug|g|ml|units?|IU|mEq)(?:\s*/\s*(?:day|daily|kg|dose))?)\b"
ROUTE = r"\b(oral(?:ly)?|IV|intravenous(?:ly)?|IM|subcutaneous(?:ly)?|SC|topical(?:ly)?|inhaled?)\b"
SEVERITY = r"\b(mild|moderate|severe|serious|fatal|life[\s-]threatening)\b"
OUTCOME = r"\b(resolv\w+|recover\w+|discharged|improved|died|fatal|death|ongoing|persistent|hospitali\w+)\b"
AGE = r"\b(\d+)[\s-]*(?:year|yr)s?[\s-]*old\b"
SEX = r"\b(male|female|man|woman|boy|girl)\b"
CAUSALITY = r"\b(probable|possible|unlikely|definite|suspected|associated with|caused by)\b"
ONSET = r"after\s+([\w\s]+?)(?:,|\.|\s+(?:he|she|the|patient))"
INDICATION = r"for\s+([\w\s]+?)(?:[.,;]|\n?\z)"
DOSE_BEFORE = r"\d+\s*(?:mg|mcg|g|ml)\b.{0,10}"

# fixed values: ordered rules of redaction, (name, pattern, replacement); each works on the text the one before it left
_MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
REDACTIONS = (
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    ("mrn", r"(?i)\b(?:MRN|Patient\s*ID|Chart\s*(?:No|#)?)[:\s#]*\d{4,12}\b", "[MRN]"),
    ("phone", r"\b(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b", "[PHONE]"),
    ("email", r"\b[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}\b", "[EMAIL]"),
    ("date", r"\b(?:\d{1,2}[/-])?\d{1,2}[/-]\d{2,4}\b", "[DATE]"),
    ("date_name", rf"(?i)\b(?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b", "[DATE]"),
    ("birth_year", r"(?i)\bborn\s+in\s+\d{4}\b", "born in [YEAR]"),
    ("birth_label", r"(?i)\b(?:DOB|Date\s+of\s+Birth)[:\s]+[\w/,-]+", "[DOB]"),
    ("name", r"\b(?:Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?|Prof\.?)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b", "[NAME]"),
    ("address", r"(?i)\b\d{1,5}\s+[A-Z][a-zA-Z\s]{2,30}(?:Street|St|Avenue|Ave|Road|Rd|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Way)\b", "[ADDRESS]"),
    ("zip", r"\b\d{5}(?:-\d{4})?\b", "[ZIP]"),
    ("facility", r"\b[A-Z][a-zA-Z\s]{2,40}(?:Hospital|Clinic|Medical\s+Center|Health\s+System|Medical\s+Group|Healthcare)\b", "[FACILITY]"),
)

# fixed values: how label texts are cut into items, and which items are none
ITEM_BREAK = r"(?<=[.!?])\s+(?=[A-Z])|;\s*"
PERCENT = r"\d+\s*%"
NUMBERS_ONLY = r"^[\d\s,.\-]+$"
DOSE_ONLY = r"^[\w\s,\-]*\d+\s*(?:mg|mcg|ug|g|ml|units?|IU)\b[\w\s,\-]*$"
FOUR_LETTERS = r"[a-zA-Z]{4,}"

# fixed values: (label field, its section's title)
SECTIONS = (
    ("warnings_and_precautions", "Warnings and Precautions"),
    ("warnings", "Warnings"),
    ("boxed_warning", "Boxed Warning"),
    ("adverse_reactions", "Adverse Reactions"),
    ("contraindications", "Contraindications"),
    ("drug_interactions", "Drug Interactions"),
    ("indications_and_usage", "Indications and Usage"),
    ("dosage_and_administration", "Dosage and Administration"),
    ("clinical_pharmacology", "Clinical Pharmacology"),
    ("mechanism_of_action", "Mechanism of Action"),
    ("pharmacokinetics", "Pharmacokinetics"),
    ("use_in_specific_populations", "Use in Specific Populations"),
    ("nursing_mothers", "Nursing Mothers"),
    ("pediatric_use", "Pediatric Use"),
    ("geriatric_use", "Geriatric Use"),
)
