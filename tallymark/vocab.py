"""The vocabularies that output tables are written in.

Every tuple here is a published vocabulary or order.  Results depend on the exact
spelling and on the order, so they are stated once, as plain text.
"""

# --- fixed values: label vocabularies ---------------------------------------
THEMES = (
    "foundation_models",
    "multimodal_integration",
    "digital_twins",
    "clinical_fda",
    "virtual_staining",
    "agentic_ai",
)
MODALITIES = (
    "he_histology",
    "ihc",
    "spatial_proteomics",
    "spatial_transcriptomics",
    "pathology_report",
    "mri",
    "ct",
    "pet",
    "ultrasound",
    "mammography",
    "xray",
    "radiology_report",
    "genomics",
    "clinical_data",
    "other",
)
CATCH_ALL = "other"
MATCH_ONLY = ("non_specialty",)

# --- fixed values: which side of the house a modality belongs to -------------
RADIOLOGY_SIDE = ("mri", "ct", "pet", "ultrasound", "mammography", "xray", "radiology_report")
PATHOLOGY_SIDE = (
    "he_histology",
    "ihc",
    "spatial_proteomics",
    "spatial_transcriptomics",
    "pathology_report",
)
NEITHER_SIDE = ("genomics", "clinical_data", "other")
DOMAIN_SERIES = ("all", "radiology", "pathology", "both", "none")

#: Themes defined by combination: fewest labels a record needs to be shown there.
MINIMUM_LABELS = {"multimodal_integration": 2}

# --- fixed values: record filters -------------------------------------------
BOOK_RECORD_TYPES = ("PubmedBookArticle",)
SECONDARY_TYPES = (
    "Review",
    "Systematic Review",
    "Meta-Analysis",
    "Editorial",
    "Comment",
    "Letter",
    "News",
    "Historical Article",
    "Guideline",
    "Practice Guideline",
    "Consensus Development Conference",
    "Published Erratum",
    "Retracted Publication",
    "Scoping Review",
)
RECORD_EXCLUSIONS = (
    "book_records",
    "missing_pmid",
    "missing_year",
    "outside_date_range",
    "non_specialty_only",
)

# --- fixed values: device registry ------------------------------------------
DEVICE_CATEGORIES = ("radiology_cancer_detection", "radiology_radiation_therapy", "pathology")
DEVICE_DOMAINS = ("radiology", "pathology")
CATEGORY_DOMAIN = {
    "radiology_cancer_detection": "radiology",
    "radiology_radiation_therapy": "radiology",
    "pathology": "pathology",
}
PATHWAYS = ("510(k)", "De Novo", "PMA")
PATHWAY_PREFIXES = {"DEN": "De Novo", "K": "510(k)", "P": "PMA"}
DEVICE_EXCLUSIONS = (
    "code_not_oncology",
    "device_not_oncology",
    "device_unresolved",
    "code_indeterminate",
    "code_unlisted_in_panel",
    "code_unlisted_off_panel",
    "pathway_unknown",
    "no_decision_date",
)
IN_SCOPE_PANELS = ("Radiology", "Pathology")
DECISIONS = ("oncology", "not_oncology", "unresolved")
CONFIDENCES = ("high", "medium")
MIN_EVIDENCE_CHARS = 25
PARTIAL_YEAR_BEFORE_MONTH = 12

# --- fixed values: validation design ----------------------------------------
RARE_MODALITIES = (
    "spatial_proteomics",
    "spatial_transcriptomics",
    "pathology_report",
    "radiology_report",
    "xray",
)
STRATA = (
    "agentic_ai",
    "virtual_staining",
    "digital_twins",
    "clinical_fda",
    "rare_modality",
    "foundation_models",
    "multimodal_integration",
    "no_theme",
)
SAMPLE_SIZES = {
    "agentic_ai": 25,
    "virtual_staining": 25,
    "digital_twins": 25,
    "clinical_fda": 25,
    "rare_modality": 20,
    "foundation_models": 40,
    "multimodal_integration": 40,
    "no_theme": 50,
}
TARGETED_STRATA = {
    "digital_twins": "theme_digital_twins = 1",
    "genomics_with_histology": "mod_genomics = 1 AND mod_he_histology = 1",
    "genomics_alone": "mod_genomics = 1 AND mod_he_histology = 0",
    "multimodal_integration": "theme_multimodal_integration = 1",
    "clinical_data": "mod_clinical_data = 1",
    "spatial_proteomics": "mod_spatial_proteomics = 1",
}
TARGETED_CATEGORY = {
    "digital_twins": "digital_twins",
    "genomics_with_histology": "genomics",
    "genomics_alone": "genomics",
    "multimodal_integration": "multimodal_integration",
    "clinical_data": "clinical_data",
    "spatial_proteomics": "spatial_proteomics",
}
AUDIT_SIZES = {"random": 25, "disagreement": 25}
CAUSES = ("mention_not_use", "term_defect", "rule_gap", "definition_boundary", "agent_error")
ROUTE_CLAIMS = {
    "pattern": "uses a data type outside the named rows",
    "fallback": "no named modality could be identified",
}

# --- fixed values: display thresholds ---------------------------------------
TOP_COMBINATIONS = 12
MIN_PAPERS_PER_COLUMN = 2
MIN_ZERO_RUN = 3
SERIES_START_YEAR = {("agentic_ai", "all"): 2024}
THIN_EVIDENCE_BELOW = 10
WILSON_Z = 1.96

# --- fixed values: text rules ------------------------------------------------
TITLE_ABSTRACT_SEPARATOR = " \n "
EXCERPT_CONTEXT = 40
YEAR_IN_TEXT = r"(1[5-9][0-9]{2}|20[0-9]{2}|21[0-9]{2})"


def canonical_order(keys, canonical):
    """Known keys in canonical order, then unknown keys in the order given."""
    keys = list(keys)
    return [k for k in canonical if k in keys] + [k for k in keys if k not in canonical]
