"""The registered queries of this folder, and SQL where SQL can express one."""

from pyspark.sql import functions as F

from tilerain.llm import (curves, exact_dedup, html_density, language_id, mixing, pair_bpe, pii, ranked_search, simhash, suffix_dedup,
                          token_counts, toxicity, whitening)
from tilerain.llm.common import table


def op1_hilbert_neighbours(spark, sf_dir):
    return curves.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op2_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
WINDOW w AS (PARTITION BY body)
"""


def op4_text_density(spark, sf_dir):
    return html_density.extracted(table(spark, sf_dir, "pages"))


def op5_bpe(spark, sf_dir):
    return pair_bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op6_personal_data(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op10_temperature_mix(spark, sf_dir):
    return mixing.copies(table(spark, sf_dir, "documents"))


def op11_polarised_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_bit_sliced_search(spark, sf_dir):
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_language_id(spark, sf_dir):
    return language_id.identified(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_hilbert_neighbours, op2_toxicity, op3_exact_dedup, op4_text_density, op5_bpe, op6_personal_data, op7_suffix_dedup,
    op8_simhash, op9_token_counts, op10_temperature_mix, op11_polarised_whitening, op12_bit_sliced_search, op13_language_id)}
ORACLES = {"op3_exact_dedup": OP3_SQL}
