"""Marker panels, thresholds, patterns and schemas of the method.

These must hold exactly these values for results to agree with published ones.
"""

# --- text tokens that mean "missing"; the sets differ on purpose -------------
MISSING_RULES = ("", "nan", "none", "null", "na")
MISSING_INTAKE = ("", "nan", "na", "none", "null", "<na>")
MISSING_LABELS_CASED = ("nan", "<NA>", "None")
MISSING_TISSUE = ("", "nan", "none", "na")
TRUTHY = ("true", "1", "yes", "y", "productive", "paired")

# --- extraction panels ------------------------------------------------------
T_MARKERS = ("CD3D", "CD3E", "CD3G", "TRAC", "TRBC1", "TRBC2", "IL7R", "LTB")
GD_MARKERS = ("TRDC", "TRGC1", "TRGC2", "TRDV1", "TRDV2", "TRDV3")
NK_MARKERS = ("NKG7", "KLRD1", "GNLY", "PRF1", "CTSW", "KLRC1", "XCL1", "XCL2")
NK_STRONG_MARKERS = ("KLRD1", "GNLY", "PRF1", "CTSW", "XCL1", "XCL2")
CONTAM_MARKERS = (
    "MS4A1", "CD79A", "CD79B", "MZB1", "LST1", "S100A8", "S100A9", "FCER1A", "C1QA",
    "C1QB", "EPCAM", "KRT8", "KRT18", "COL1A1", "DCN", "HBA1", "HBB", "PPBP",
)
EXTRACTION_PANELS = {
    "t": T_MARKERS,
    "gd": GD_MARKERS,
    "nk": NK_MARKERS,
    "nk_strong": NK_STRONG_MARKERS,
    "contam": CONTAM_MARKERS,
}

# --- column-name hints ------------------------------------------------------
ANNOTATION_HINTS = (
    "celltype", "cell_type", "annotation", "annot", "label", "cluster", "lineage",
    "major", "sub_cell_type", "pred", "identity", "ident",
)
DONOR_HINTS = ("donor", "patient", "subject", "individual")
SAMPLE_HINTS = ("sample", "orig.ident", "specimen", "biosample")
LIBRARY_HINTS = ("library", "library_id", "batch", "lane", "channel")
COUNTS_LAYER_PRIORITY = ("counts", "raw_counts", "count", "umi_counts")

# --- annotation patterns (searched ignoring case) ---------------------------
ANNOTATION_POSITIVE = (
    r"(?:^|[^A-Za-z])T(?:[^A-Za-z]|$)",
    r"T/?NK", r"CD3", r"CD4", r"CD8", r"NK", r"MAIT", r"gamma.?delta", r"gdt",
    r"TRDV", r"TRGC", r"TRDC", r"Treg",
)
ANNOTATION_NEGATIVE = (
    r"(?:^|[^A-Za-z])B(?:[^A-Za-z]|$)",
    r"plasma", r"M/DC", r"MNP", r"myeloid", r"mono", r"macroph", r"DC", r"pDC",
    r"cDC", r"eryth", r"RBC", r"mast", r"fibro", r"strom", r"epithelial", r"doublet",
)

# --- cleanup ----------------------------------------------------------------
CLEANUP_PANELS = {
    "myeloid": ("LYZ", "FCER1G", "CTSS", "AIF1", "LST1", "SAT1", "CST3"),
    "bcell": ("MS4A1", "CD79A", "CD74", "HLA-DRA"),
    "epithelial": ("EPCAM", "KRT8", "KRT18", "KRT19"),
    "erythroid": ("HBB", "HBA1", "HBA2"),
    "platelet": ("PF4", "PPBP"),
}
KEY_GENES = (
    "TRAC", "TRBC1", "TRBC2", "TRDC", "TRGC1", "TRGC2", "CD3D", "CD3E", "CD3G", "NKG7", "KLRD1",
)
REASON_PRIORITY = (
    "low_quality", "extreme_phase1_contam", "myeloid_conflict", "bcell_conflict",
    "epithelial_conflict", "erythroid_conflict", "platelet_conflict",
)
MIN_GENE_CELLS = 500
MAX_CELL_TOTAL = 100_000

# --- scoring ----------------------------------------------------------------
TARGET_SUM = 1e4
MODULE_PATTERNS = {
    "tra": r"^TRAC$|^TRAV|^TRAJ",
    "trb": r"^TRBC|^TRBV|^TRBJ",
    "trd": r"^TRDC$|^TRDV|^TRDJ",
}
CONTROL_BINS = 25
CONTROL_SIZE = 50

# --- genes kept out of variable-gene selection ------------------------------
RIBOSOMAL_PREFIXES = ("RPS", "RPL", "MRPS", "MRPL")
NONCODING_PREFIXES = (
    "LINC", "MIR", "MIRLET", "SNHG", "SNORA", "SNORD", "SCARNA", "RNU", "RN7", "RNA5",
    "RNA18", "RNA28", "YRNA", "Y_RNA", "RMRP", "RPPH1", "XIST", "TSIX", "NEAT1", "MALAT1",
)
NONCODING_CLONE = (
    r"^(AC[0-9]+|AL[0-9]+|AP[0-9]+|BX[0-9]+|RP[0-9]+-|CTA-|CTB-|CTC-|CTD-|CTE-|CU-|DKFZP)"
)
NONCODING_SUBSTRINGS = (
    "MALAT1", "NEAT1", "XIST", "LINC", "MIR", "SNOR", "SNORA", "SNORD", "SCARNA", "RNU",
)

# --- cluster annotation -----------------------------------------------------
CLUSTER_GENE_GROUPS = {
    "gdt": ("TRDC", "TRDV1", "TRDV2", "TRGV9"),
    "treg": ("FOXP3", "IL2RA", "CTLA4", "TIGIT", "IKZF2"),
    "nk": ("NKG7", "GNLY", "KLRD1", "FCER1G", "PRF1", "CTSW"),
    "tcell": ("CD3D", "CD3E", "TRAC", "TRBC1", "TRBC2"),
    "cd4": ("CD4", "IL7R", "LTB", "MAL"),
    "cd8": ("CD8A", "CD8B", "CCL5", "PRF1"),
}
T_LABEL_TERMS = (
    "t cell", "t-cell", "alpha-beta t", "gamma-delta t", "gd t", "cytotoxic t",
    "helper t", "regulatory t", "memory t", "naive t",
)

AGREEMENT_GENES = ("CD3D", "TRAC", "TRDC", "NKG7", "KLRD1", "FCER1G", "EPCAM")
DOT_GENES = (
    "FOXP3", "IL2RA", "CTLA4", "CD4", "IL7R", "LTB", "CD8A", "CD8B", "CCL5", "NKG7", "GNLY", "KLRD1",
)

# --- receptor schema --------------------------------------------------------
CHAINS_AB = ("TRA", "TRB")
CHAINS_ALL = ("TRA", "TRB", "TRG", "TRD")
CHAIN_TEXT_FIELDS = ("cdr3", "v", "d", "j", "cdr3_nt", "clone_id")
CHAIN_NUMBER_FIELDS = ("umis", "reads")

# --- metadata schema --------------------------------------------------------
BASE_CELL_COLUMNS = (
    "gse_id", "cell_id", "source_h5ad", "source_root", "library_id", "sample_id", "donor_id",
    "age", "sex", "tissue", "condition", "treatment", "enrichment_strategy", "assay_type",
    "tcr_availability", "original_cell_annotation", "sample_type", "donor_patient",
    "technology_simple", "tcr_vdj_flag", "TCRseq",
)
# target column -> source columns in order of preference
METADATA_ALIASES = {
    "project name": ("project name", "Project", "source_name", "reference"),
    "sample_id": ("sample_id", "sampleid", "sample_ID", "sample", "orig.ident", "cell_to_sample_ID", "Sample Name"),
    "sampleid": ("sampleid", "sample_id", "sample_ID", "sample", "orig.ident", "cell_to_sample_ID", "Sample Name"),
    "library_id": ("library_id", "Sample Name", "sample", "sample_id", "sampleid", "orig.ident", "batch"),
    "donor_id": ("donor_id", "donor", "Donor", "patient_ID", "patient_id", "patient"),
    "tissue": ("tissue_corrected", "tissue", "Tissue", "Tissue_merged", "tissue_region", "source_name"),
    "tissue_corrected": ("tissue_corrected", "tissue", "Tissue", "Tissue_merged", "tissue_region"),
    "condition": ("condition", "colon_status", "disease", "group", "Stage", "treatment"),
    "assay_type": ("assay_type",),
    "technology_simple": ("technology_simple", "library_chemistry"),
    "input_population": ("input_population",),
    "Sorted_gdT": ("Sorted_gdT",),
    "tcr_chain_mode": ("tcr_chain_mode",),
    "barcodes": ("barcodes", "barcode", "cell_barcode", "cellbarcode"),
    "barcode": ("barcode", "barcodes", "cell_barcode", "cellbarcode"),
    "barcode_core": ("barcode_core",),
}
METADATA_DEFAULTS = {
    "assay_type": "scRNA",
    "technology_simple": "10x_scRNA",
    "input_population": "tnk_subset",
    "Sorted_gdT": "False",
    "tcr_chain_mode": "none",
}
ORIGINAL_ID_COLUMNS = ("original_cell_id", "cell_id", "obs_name", "raw_obs_name")
DATASET_ID_COLUMNS = ("source_gse_id", "gse_id", "GSE")
KEEP_COLUMNS = (
    "original_cell_id", "source_gse_id", "project name", "sampleid", "sample_id", "library_id",
    "barcodes", "barcode", "barcode_core", "donor_id", "tissue", "tissue_corrected", "condition",
    "technology_simple", "assay_type", "input_population", "Sorted_gdT", "tcr_chain_mode", "TCRseq",
)
STALE_COLUMNS = (
    "phase4_tra_score", "phase4_trb_score", "phase4_trab_score", "phase4_trd_score",
    "phase4_trd_minus_trab", "phase4_trab_score_scaled", "phase4_trd_score_scaled",
    "phase4_trd_minus_trab_scaled", "phase3_batch_key", "phase3_batch_level", "leiden",
    "simple_annotation", "simple_annotation_plus6", "scanvi_detailed_label", "scanvi_label_confidence",
    "scanvi_tnk_superclass", "scanvi_reference_other_flag", "scanvi_transfer_method",
)
