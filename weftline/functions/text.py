"""Texts: words of a question and composed Unicode."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .keys import normal_name

#: Words that a search leaves out.
STOP_WORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "her", "was", "one", "our", "out", "has", "have", "what", "who",
    "how", "when", "where", "which", "with", "that", "this", "from", "they", "been", "will", "each", "make", "like", "most", "many", "some",
]
#: Fixed value: what parts the words of a question.
BETWEEN = r"[\s\-_/.,;:!?()]+"


def question_tokens(c: Column) -> Column:
    """FN-13: lower-case words of at least three letters that are not stop words, in order."""
    return F.filter(F.split(F.lower(c), BETWEEN), lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS))


@F.pandas_udf(StringType())
def composed(c: pd.Series) -> pd.Series:
    """NFC, the one scalar that Spark lacks."""
    return c.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def canonical_name(c: Column) -> Column:
    """FN-07 with composition; plain ASCII texts need no Python."""
    return normal_name(composed(c))
