"""One consistent form of text that looks the same in different characters.

Look-alike letters are mapped to Latin ones and what does not show is removed; the mapped values are then grouped in SQL
under the accent-sensitive, case-insensitive Unicode collation UNICODE_CI, to which width, style and the encoding of an
accent make no difference. Each class gets a canonical member: plain ASCII before other text, then the shortest, then
the smallest in binary order. Joining it back gives every value its form. Only distinct values are grouped, so a value
that holds a third of all rows counts once.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.session import broadcast_if_small, materialize

#: Latin letters, each followed by letters of other scripts or shapes that look like it.
LOOKALIKES = """
a ɑαаᴀ  b ʙƄЬ  c сϲⲥᴄ  d ԁᴅ  e еҽᴇ  f ꜰ  g ɡցɢ  h һհʜ  i іıιɩɪ  j јϳᴊ  k κкᴋ  l ӏӀʟ  m ᴍ  n ոɴ  o οоօᴏⲟ  p рρⲣᴘ
q ԛգ  r ʀ  s ѕꜱſ  t ᴛ  u υսᴜʋ  v νѵᴠ  w ԝѡաᴡ  x х  y уүγʏ  z ᴢ
A ΑАᎪ  B ΒВᏴ  C СϹᏟⲤ  D Ꭰ  E ΕЕᎬ  F Ϝ  G ԌᏀ  H ΗНᎻⲎ  I ΙІⲒ  J ЈᎫͿ  K ΚКᏦⲔ  L ᏞⳐ  M ΜМᎷⲘ  N ΝⲚ  O ΟОՕⲞ  P ΡРᏢⲢ
Q Ԛ  R Ꭱ  S ЅՏᏚ  T ΤТᎢⲦ  U Ս  V ѴᏙ  W ԜᎳ  X ΧХⲬ  Y ΥУҮⲨ  Z ΖᏃⲌ
"""

#: What is disregarded, as a Java pattern: blanks, hyphens of all kinds, underscores, characters that do not show.
DISREGARDED = (
    r"(?U)[\s\p{Z}\p{Cc}\p{Cf}\p{Pd}\p{Pc}\x{2212}\x{02D7}\x{2043}\x{2796}\x{2800}\x{3164}\x{115F}\x{1160}\x{FFA0}"
    r"\x{034F}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]+"
)
COLLATION = "UNICODE_CI"
#: More than one mark on a letter may stand in any order, and marks on letters of the collation's blind spots need composing.
_IRREGULAR = r"\p{M}\p{M}|[\x{00C0}-\x{024F}\x{0370}-\x{052F}\x{1E00}-\x{1FFF}]\p{M}"


def lookalike_map() -> dict[str, str]:
    """Letter to Latin letter, with the accented letters of other scripts that decompose into a mapped letter and marks."""
    words = LOOKALIKES.split()
    basic = {c: latin for latin, others in zip(words[::2], words[1::2], strict=True) for c in others}
    accented = {}
    for code in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base in basic:
            target = unicodedata.normalize("NFC", basic[base] + "".join(marks))
            if len(target) == 1:
                accented[chr(code)] = target
    return basic | accented


def mapped(value: Column) -> Column:
    """``value`` without what is disregarded, look-alike letters in Latin. Null stays null."""
    table = lookalike_map()
    return F.translate(F.regexp_replace(value, DISREGARDED, ""), "".join(table), "".join(table.values()))


def first_label(host: Column) -> Column:
    """A host up to its first dot, without a leading ``*.``."""
    return F.regexp_extract(F.regexp_replace(host, r"\A\s*\*\.", ""), r"\A([^.\x{3002}\x{FF0E}\x{FF61}]*)", 1)


def _regular(value: str | None) -> str | None:
    if value is None:
        return None
    bare = value.strip()
    if bare[:4].lower() == "xn--":
        try:
            value = bare[4:].encode("ascii").decode("punycode")
            value.encode("utf-8")
        except (UnicodeError, ValueError, OverflowError):
            return bare
    return unicodedata.normalize("NFC", value)


def _regular_udf():
    """Made when a session exists."""

    def regular(values: pd.Series) -> pd.Series:
        return values.map(_regular)

    return F.pandas_udf(regular, "string")


def read_values(values: DataFrame) -> DataFrame:
    """raw -> raw, text: ``xn--`` values stand for what they encode (as written if that's broken).

    Python sees only those and the few values with piled-up marks; all others stay in the JVM.
    """
    odd = F.lower(F.substring(F.trim("raw"), 1, 4)).eqNullSafe("xn--") | F.coalesce(F.col("raw").rlike(_IRREGULAR), F.lit(False))
    plain = values.where(~odd).select("raw", F.col("raw").alias("text"))
    return plain.unionByName(values.where(odd).select("raw", _regular_udf()(F.col("raw")).alias("text")))


def canonical_forms(values: DataFrame) -> DataFrame:
    """raw -> raw, text, form for distinct raw values: texts that read the same get the same form.

    Values that are null or hold nothing that shows have no row.
    """
    spark = values.sparkSession
    distinct = materialize(values.where("raw is not null").distinct(), "lookalike-raw")
    read = materialize(read_values(distinct).withColumn("mapped", mapped(F.col("text"))), "lookalike-values").where("mapped <> ''")
    return spark.sql(
        f"""
        WITH classes AS (
          SELECT collate(mapped, '{COLLATION}') AS class, min(struct(text rlike '[^\\\\x00-\\\\x7f]', length(text), text)).text AS form
          FROM {{read}} GROUP BY 1)
        SELECT v.raw, v.text, c.form FROM {{read}} v JOIN classes c ON collate(v.mapped, '{COLLATION}') = c.class
        """,
        read=read,
    )


def not_ascii(value: Column) -> Column:
    return value.rlike(r"[^\x00-\x7f]")


def matching_terms(names: DataFrame, name_id: str, name: str, terms: DataFrame, term_id: str, phrase: str, only_disguised: bool = True) -> DataFrame:
    """name_id, term_id where the first label of ``name`` reads the same as the whole ``phrase``.

    only_disguised: label or phrase contains a non-ASCII character. Null names, phrases and ids match nothing; repeated
    rows match as often as they occur.
    """
    labelled = names.select(F.col(f"`{name_id}`").alias("_name_id"), first_label(F.col(f"`{name}`")).alias("_raw"))
    phrased = terms.select(F.col(f"`{term_id}`").alias("_term_id"), F.col(f"`{phrase}`").alias("_phrase"))
    values = labelled.select(F.col("_raw").alias("raw")).distinct().unionByName(phrased.select(F.col("_phrase").alias("raw")).distinct())
    forms = materialize(canonical_forms(values), "lookalike-forms")
    by_term = phrased.join(forms, F.col("_phrase") == F.col("raw")).select("_term_id", F.col("form").alias("_form"), not_ascii(F.col("text")).alias("_odd"))
    by_term, _ = broadcast_if_small(materialize(by_term, "lookalike-terms"))
    hits = forms.join(by_term, F.col("form") == F.col("_form")).where(F.lit(not only_disguised) | F.col("_odd") | not_ascii(F.col("text"))).select("raw", "_term_id")
    hits, small = broadcast_if_small(materialize(hits, "lookalike-hits"))
    met = labelled.join(hits, F.col("_raw") == F.col("raw")) if small else _met_by_label(labelled, hits)
    return met.select(F.col("_name_id").alias(name_id), F.col("_term_id").alias(term_id))


#: A label that this part of the rows or more have meets its terms without a shuffle of those rows.
HOT_SHARE = 1e-3


def _met_by_label(labelled: DataFrame, hits: DataFrame) -> DataFrame:
    """labelled x hits by label where hits are too many to broadcast: rows of hot labels, of which there are few, apart."""
    counts = materialize(labelled.groupBy(F.col("_raw").alias("_label")).agg(F.count(F.lit(1)).alias("_n")), "label-counts")
    every = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where(F.col("_n") >= F.lit(max(1.0, HOT_SHARE * every))).select("_label"))  # at most 1 / HOT_SHARE rows
    of_hot, _ = broadcast_if_small(materialize(hits.join(hot, F.col("raw") == F.col("_label"), "left_semi"), "hot-hits"))
    cold = labelled.join(hot, F.col("_raw") == F.col("_label"), "left_anti").join(hits, F.col("_raw") == F.col("raw"))
    warm = labelled.join(hot, F.col("_raw") == F.col("_label"), "left_semi").join(of_hot, F.col("_raw") == F.col("raw"))
    return cold.unionByName(warm)
