from pyspark.sql import functions as F

from cytoquilt.functions import barcodes, columns, genes, labels, numbers, text


def values(spark, inputs, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


MISSING = [None, "", " \t", "nan", "NA", "None", "null", "<NA>", " NaN ", "x "]


def test_missing_token_sets_differ(spark):
    assert values(spark, MISSING, text.clean) == ["", "", "", "", "", "", "", "<NA>", "", "x"]
    assert values(spark, MISSING, text.clean_intake) == [""] * 9 + ["x"]
    assert values(spark, MISSING, text.blank_to_null) == [None, None, None, "nan", "NA", "None", "null", "<NA>", "NaN", "x"]
    assert values(spark, MISSING, text.portable_label) == ["", "", " \t", "", "NA", "", "null", "", " NaN ", "x "]
    assert values(spark, [" x "], text.strip) == ["x"]


def test_match_text_splits_letters_and_digits(spark):
    inputs = ["COVID19_patient-A", "CD4+ (T)", "hd1_", None, "a1b2", "x / y|z"]
    assert values(spark, inputs, text.match_text) == ["covid 19 patient a", "cd 4 t", "hd 1", "", "a 1 b 2", "x y z"]
    assert values(spark, ["CD4+ (T)", "a-b_c"], text.match_text_tissue) == ["cd 4+ t", "a-b c"]


def test_gene_symbols(spark):
    names = ["GRCh38_TRAC", "hg38-TRAC", "trac", " mm10__Cd3e", "ENSG0001", "MT-CO1", "GRCm39:x", "HGX_1"]
    assert values(spark, names, genes.canonical_symbol) == ["TRAC", "TRAC", "TRAC", "CD3E", "ENSG0001", "MT-CO1", "X", "HGX_1"]
    assert [genes.canonical_symbol_py(n) for n in names] == values(spark, names, genes.canonical_symbol)
    assert values(spark, ["MT-CO1", "mt-co1"], genes.is_mitochondrial) == [True, False]
    flags = lambda name: (lambda c: genes.variable_gene_flags(c)[name])
    names = ["MT-CO1", "RPL3", "MRPS2", "LINC001", "AC0123", "RP11-5", "MIR7", "TRAC", "ACTB"]
    assert values(spark, names, flags("exclude_reason")) == [
        "mitochondrial", "ribosomal", "ribosomal", "noncoding_like", "noncoding_like", "noncoding_like", "noncoding_like", "", "",
    ]
    assert values(spark, ["XMIRX", "TRAC"], genes.is_noncoding_name) == [True, False]


def test_barcodes(spark):
    codes = ["AAACCTGAGAACAATC-1-0-1", "lib:AAAC-1", "AAAC_1", "aaac-2", " ", None, "xx-ACGT-1-zz", "run_ACG-1_ACT-2"]
    assert values(spark, codes, barcodes.barcode_core) == ["AAACCTGAGAACAATC", "AAAC", "AAAC_1", "AAAC", "", "", "ACGT", "ACT"]
    assert values(spark, ["lib:aaac-1_x", "none", "zz"], barcodes.full_barcode) == ["AAAC-1", "", "ZZ".lower()]
    assert values(spark, ["ACGT-1", "ACGT_12", "lib:ACGT-3", None], barcodes.stripped_core) == ["ACGT", "ACGT", "ACGT", ""]
    assert values(spark, ["GSE1__run_ACGT-1", "x"], barcodes.barcode_from_name) == ["ACGT-1", "x"]
    assert values(spark, ["ACGT-1-2_s", "ACGT-1", "A-b-c", "nan"], barcodes.aligned_barcode) == ["ACGT-1", "ACGT-1", "A-b-c", ""]


def test_receptor_text(spark):
    pairs = ["TRB:x;TRA:y", "TRA: ;TRA:z;TRA:w", "nothing", None, "tra : a:b "]
    assert values(spark, pairs, lambda c: barcodes.cdr3_of_chain(c, "TRA")) == ["y", "z", "", "", "a:b"]
    assert values(spark, ["P001", "p12", "Q1", "P000"], barcodes.short_patient) == ["P1", "P12", "Q1", "P0"]


def test_flags_and_labels(spark):
    assert values(spark, [" Yes", "0", "maybe", None], text.yes_no) == ["yes", "no", "", ""]
    assert values(spark, ["TRUE", "productive", "no", None], text.is_truthy) == [True, True, False, False]
    got = values(spark, ["Natural killer cell", "nk cell", "T-helper 1 cell", "CD8 T cell", "", None, "nk t cell"], labels.superclass)
    assert got == ["NK_cell", "NK_cell", "reference_other", "T_cell", "reference_other", "reference_other", "T_cell"]


def test_integer_like_tolerance(spark):
    df = spark.createDataFrame([(3.0,), (3.00003,), (3.1,), (0.0,), (1e-6,), (2e-6,), (-2.0,)], "v double")
    got = [r[0] for r in df.select(numbers.is_integer_like("v")).collect()]
    assert got == [True, True, False, True, True, False, True]


def test_schema_helpers(spark):
    cols = ["Patient_ID", "sample", "orig.ident", "cell_type", "cluster_x", "Library", "donor"]
    assert columns.annotation_columns(cols) == ["orig.ident", "cell_type", "cluster_x"]
    assert columns.first_hinted_column(cols, ("donor", "patient")) == "donor"
    assert columns.metadata_fields(cols) == {"donor": "Patient_ID;donor", "sample": "orig.ident;sample", "library": "Library"}
    df = spark.createDataFrame([(" ", "b")], "a string, b string")
    assert df.select(columns.text_from(df, ["a", "b"])).first()[0] is None
    assert df.select(text.first_nonblank("a", "b")).first()[0] == "b"
    assert columns.keep_exactly(df, ["b", "c", "has_x"]).first().asDict() == {"b": "b", "c": "", "has_x": False}
