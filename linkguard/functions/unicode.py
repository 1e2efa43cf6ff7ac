"""Unicode helpers that Spark has no built-in for.

Arrow-batched, and meant to be applied only to the few rows with non-ASCII or ``xn--`` text.
The functions are built inside factories so that they travel to executors by value.
"""



import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from linkguard import constants as C


def idna_encodable(host: Column) -> Column:
    """True when a host has an IDNA form that differs from it."""
    def encodable(text):
        try:
            return text.encode("idna").decode("ascii") != text
        except UnicodeError:
            return False

    def run(s: pd.Series) -> pd.Series:
        return s.map(encodable, na_action="ignore")
    return F.pandas_udf(run, T.BooleanType())(host)


def fold_label(label: str) -> Column:
    """struct(normalized, has_homoglyph, latin): the accent-free form, whether look-alike
    characters occur, and their Latin reading."""
    glyphs = dict(C.HOMOGLYPHS)

    def run(s: pd.Series) -> pd.DataFrame:
        import unicodedata

        def single_ascii(ch):
            d = unicodedata.normalize("NFKD", ch)
            return d if len(d) == 1 and ord(d) < 128 else None

        rows = []
        for text in s.fillna(""):
            plain = "".join(c for c in unicodedata.normalize("NFKD", text)
                            if not unicodedata.combining(c))
            odd = any(c in glyphs or (ord(c) > 127 and single_ascii(c) is None) for c in text)
            latin = "".join(glyphs.get(c) or single_ascii(c) or c for c in text)
            rows.append((plain, odd, latin))
        return pd.DataFrame(rows, columns=["normalized", "has_homoglyph", "latin"])

    schema = T.StructType([T.StructField("normalized", T.StringType()),
                           T.StructField("has_homoglyph", T.BooleanType()),
                           T.StructField("latin", T.StringType())])
    return F.pandas_udf(run, schema)(F.col(label))


def punycode_decode(label: str) -> Column:
    """Unicode text of an ``xn--`` label, NULL when it cannot be decoded."""
    def decode(text):
        for attempt in (lambda: text.encode("ascii").decode("idna"),
                        lambda: text[4:].encode("ascii").decode("punycode")):
            try:
                return attempt()
            except (UnicodeError, ValueError):
                continue
        return None

    def run(s: pd.Series) -> pd.Series:
        return s.map(decode, na_action="ignore")
    return F.pandas_udf(run, T.StringType())(F.col(label))


def punycode_encode(text: str) -> Column:
    """The encoded form of a label, without the ``xn--`` in front."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x.encode("punycode").decode("ascii"), na_action="ignore")
    return F.pandas_udf(run, T.StringType())(F.col(text))
