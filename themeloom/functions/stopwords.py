"""Stop words.

``ENGLISH`` is the public English list used for normalising text. Longer lists (a vectorizer's own, or
one for another language) are passed as the ``stop_words`` argument of the operators, or read from a
file with :func:`read_stop_words`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

# The published English stop-word list.
ENGLISH = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves "
    "he him his himself she she's her hers herself it it's its itself they them their theirs themselves "
    "what which who whom this that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don don't should should've now "
    "d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't "
    "haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't "
    "wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

MAX_STOP_WORDS = 100_000


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """One word per line. The list becomes part of the plan, so its length is checked."""
    rows = (
        spark.read.text(path)
        .select(F.lower(F.trim("value")).alias("word"))
        .where("word <> ''")
        .distinct()
        .limit(MAX_STOP_WORDS + 1)
        .collect()
    )
    if len(rows) > MAX_STOP_WORDS:
        raise ValueError(f"{path} has more than {MAX_STOP_WORDS} stop words")
    return sorted(r.word for r in rows)
