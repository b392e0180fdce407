"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, line_dedup, media, merkle, mixing, ngram_join, packing, pseudonyms, quantised, repair, secrets, spelling, toxicity

QUERIES = {
    "op1_pseudonyms": pseudonyms.query,
    "op2_repair": repair.query,
    "op3_quantised": quantised.query,
    "op4_media": media.query,
    "op5_packing": packing.query,
    "op6_mixing": mixing.query,
    "op7_secrets": secrets.query,
    "op8_ngram_join": ngram_join.query,
    "op9_toxicity": toxicity.query,
    "op10_line_dedup": line_dedup.query,
    "op11_merkle": merkle.query,
    "op12_bpe": bpe.query,
    "op13_spelling": spelling.query,
}

SQL = {"op8_ngram_join": ngram_join.SQL, "op10_line_dedup": line_dedup.SQL, "op11_merkle": merkle.SQL, "op13_spelling": spelling.SQL}
