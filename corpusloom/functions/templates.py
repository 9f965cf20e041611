"""Strings that must match exactly for results to agree."""

# Spellings read as a missing value when a CSV corpus is loaded.
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Annotation labels compared between annotators, and the rest class.
AGREEMENT_LABELS = ("No FCD", "Possible FCD", "Highly probable FCD", "FCD")
NOT_RELEVANT = "Not relevant"

# Known unlabelled corpora and their parts.
CORPUS_PARTS = {
    "clinical_notes": "anonymized_clinical_notes_part{part}.csv",
    "radiology_reports": "anonymized_radiology_reports_part{part}.csv",
}
PARTS = (1, 2, 3)

# Instruction prefix.
TASK = (
    "Classify the medical text describing focal cortical dysplasia (i.e., FCD) as either {categories}"
)
INSTRUCTION = "Instruct: {task}\nQuery: "
TRANSLATE_PREFIX = "<2en> "

# Marks in tokens and answers.
WORDPIECE_MARK = "##"
INVALID_LABEL = "INVALID LABEL: "
INVALID_MATCH = "INVALID OUTPUT MATCH: "
CATEGORY_PATTERN = ">>>\nCategory: ([^\n]*)\n"
CATEGORY_PATTERN_DA = ">>>\nKategori: ([^\n]*)\n"

# Prompt texts.
ROLE_INST = (
    "You are an experienced radiologist that help users extract infromation from radiology reports."
)
ROLE = "You are an experienced radiologist that help users extract information from radiology reports."
TASK_CATEGORIES = " Your task is to categorize texts in the following categories:\n\n"
TASK_INQUIRY = (
    " Categorize the text in <<<>>> into one of the following predefined categories:\n\n"
)
RULES = (
    '\n\nYou will only respond with the category. Do not include the word "Category".'
    " Do not provide explanations or notes."
)
ROLE_DA = (
    "Du er en erfaren radiolog, der hjælper brugere med at udtrække informationer fra"
    " radiologirapporter. Kategoriser teksten i <<<>>> i en af \u200b\u200bfølgende foruddefinerede"
    " kategorier:\n\n"
)
RULES_DA = (
    '\n\nDu svarer kun med kategorien. Medtag ikke ordet "Kategori".'
    " Giv ikke forklaringer eller noter."
)
EXAMPLES = "\n\n####\nHere are some examples:\n\n"
EXAMPLES_DA = "\n\n####\nHer er nogle eksempler:\n\n"
CATEGORIZE = "Categorize the text: "

# Generation parameters per prompt family.
SAMPLING_COMPLETION = {"max_new_tokens": 10, "temperature": 0.7, "top_k": 50, "top_p": 0.95}
SAMPLING_CHAT = {"max_new_tokens": 256, "temperature": 0.6, "top_p": 0.9}
