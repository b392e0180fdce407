"""Operator 9 on texts that are short or mostly toxic."""

import pyarrow as pa

from quire.llm import toxicity

from .helpers import table_of


def test_short_and_mostly_toxic_texts(spark):
    docs, labels = (table_of(spark, t, "/root/testdata/sf0.1") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    toxic = ["idiot", "idiot clown", "ered. pathetic loser", "pathetic loser idiot clown", "moron trash idiot loser clown the and of", "idiot " * 100]
    clean = ["", "the", "the public version", "und nicht die"]
    assert min(model.score(pa.array(toxic))) > 0.5 > max(model.score(pa.array(clean)))
    few, more = model.score(pa.array(["the public version of this idiot clown", "the public version of this " + "idiot clown " * 20]))
    assert few <= more
