from revisio.llm import ann, copies, crossent, decontam, licences, mixing, neardup, periods, pii, quality, suffixes, trie, wrappers


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


QUERIES = {
    "op1_neardup": lambda spark, d: neardup.groups(table(spark, d, "documents")),
    "op10_pii": lambda spark, d: pii.spans(table(spark, d, "documents")),
    "op11_copies": lambda spark, d: copies.groups(table(spark, d, "documents")),
    "op12_trie": lambda spark, d: trie.trie(table(spark, d, "conversations")),
    "op13_periods": lambda spark, d: periods.periodic(table(spark, d, "documents")),
    "op2_crossent": lambda spark, d: crossent.score(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_licences": lambda spark, d: licences.scan(table(spark, d, "documents")),
    "op4_html": lambda spark, d: wrappers.main_text(table(spark, d, "pages")),
    "op5_ann": lambda spark, d: ann.search(table(spark, d, "embeddings")),
    "op6_decontam": lambda spark, d: decontam.overlaps(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op7_mixing": lambda spark, d: mixing.mix(table(spark, d, "documents")),
    "op8_suffixes": lambda spark, d: suffixes.removed(table(spark, d, "documents")),
    "op9_quality": lambda spark, d: quality.quality(table(spark, d, "documents"), table(spark, d, "labels")),
}
SQL = {"op11_copies": copies.SQL, "op12_trie": trie.SQL, "op13_periods": periods.SQL, "op2_crossent": crossent.SQL, "op3_licences": licences.sql(), "op5_ann": ann.SQL, "op7_mixing": mixing.SQL}
