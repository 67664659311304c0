"""Queries p5_ to p8_ over texts, and SQL for those that SQL can state."""

from __future__ import annotations

from prismgrid.llm import bpe, mixing, pii, quality
from prismgrid.sources.tables import table


def _tagger(spark, sf):
    return pii.fit(table(spark, sf, "pii_labels"), table(spark, sf, "person_names"))


def p5_found(spark, sf):
    return pii.find_items(table(spark, sf, "elements"), _tagger(spark, sf)).drop("end_pos")


def p5_redacted(spark, sf):
    return pii.redact_fields(table(spark, sf, "elements"), _tagger(spark, sf))


def p6_ids(spark, sf):
    return bpe.encode_documents(table(spark, sf, "documents"))


def p7_choice(spark, sf):
    return mixing.mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p7_shares(spark, sf):
    return mixing.mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p8_found(spark, sf):
    kinds = quality.classify_texts(table(spark, sf, "documents"), table(spark, sf, "common_words"))
    return kinds.where("kind <> 'prose'").select("doc_id", "kind").distinct()


def p8_stats(spark, sf):
    return quality.classify_texts(table(spark, sf, "documents"), table(spark, sf, "common_words"))


QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted, "p6_ids": p6_ids, "p7_choice": p7_choice, "p7_shares": p7_shares, "p8_found": p8_found, "p8_stats": p8_stats}
SQL: dict[str, str] = {}
