"""Theta joins as equi-joins: suffix, containment, edit distance, interval and either-endpoint joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.functions.text import bound
from lookout.session import broadcast_if_small, materialize

try:
    import ahocorasick
except ImportError:  # the equi-join on first characters serves then
    ahocorasick = None


def suffixes(host: Column, proper: bool = False) -> Column:
    """A host and its dot-suffixes, longest first; ``proper`` leaves the host itself out. Null for null."""
    labels = F.split(host, r"\.")
    first = 2 if proper else 1
    n = F.size(labels)
    many = F.transform(F.sequence(F.lit(first), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host.isNull(), None).when(n < first, F.array().cast("array<string>")).otherwise(many)


def suffix_join(left: DataFrame, host: str, right: DataFrame, domain: str, exact: Column | None = None, proper: bool = False) -> DataFrame:
    """Left columns with the right columns whose ``domain`` the host equals or lies under; the longest one only.

    ``exact``: a condition on right rows that match equal hosts only; ``proper``: equal hosts don't match. Rows without a
    match are left out. Right rows of the same domain: the smallest struct of their columns. Clashing names: the right
    columns come as ``right``, a struct.

    Domains of n labels meet the host's last n labels by equality, one join for each n that domains have. Within the
    broadcast's bounds no left row is shuffled; beyond them every host becomes its few suffixes, distinct hosts once.
    """
    marked = right.where(F.col(domain).isNotNull()).select(F.col(domain).alias("_domain"), (exact if exact is not None else F.lit(False)).alias("_exact"), F.struct(*right.columns).alias("right"))
    best = marked.groupBy("_domain").agg(F.min("right").alias("_own"), F.min(F.when(~F.coalesce("_exact", F.lit(False)), F.col("right"))).alias("_any"))
    best = materialize(best.withColumn("_labels", F.size(F.split("_domain", r"\."))), "suffix-domains")
    _, small = broadcast_if_small(best)
    sizes = sorted((r[0] for r in best.select("_labels").distinct().collect()), reverse=True)
    h, n_labels = F.col(host), F.size(F.split(host, r"\."))
    found = lambda own, any_, at: F.when(h == at, F.lit(None) if proper else own).otherwise(any_)
    if small:
        out, picks = left, []
        for n in sizes:
            side = F.broadcast(best.where(F.col("_labels") == n).select(F.col("_domain").alias(f"_d{n}"), F.col("_own").alias(f"_o{n}"), F.col("_any").alias(f"_a{n}")))
            out = out.join(side, (n_labels >= n) & (F.substring_index(h, ".", -n) == F.col(f"_d{n}")), "left")
            picks.append(found(F.col(f"_o{n}"), F.col(f"_a{n}"), F.col(f"_d{n}")))
        kind = best.schema["_own"].dataType
        return out.withColumn("_right", F.coalesce(*picks) if picks else F.lit(None).cast(kind)).where("_right is not null").select(*left.columns, F.col("_right").alias("right"))
    hosts = left.where(h.isNotNull()).select(h.alias("_host")).distinct()
    met = hosts.withColumn("_suffix", F.explode(suffixes(F.col("_host"), proper))).join(best, F.col("_suffix") == F.col("_domain"))
    met = met.withColumn("_right", F.when(F.col("_host") == F.col("_domain"), F.col("_own")).otherwise(F.col("_any"))).where("_right is not null")
    longest = met.groupBy("_host").agg(F.max_by("_right", "_labels").alias("_right"))
    return left.join(longest, h == F.col("_host")).select(*left.columns, F.col("_right").alias("right"))


def find_all(text: Column, term: Column) -> Column:
    """0-based starts of all, also overlapping, occurrences of a term; none for the empty term."""
    starts = F.sequence(F.lit(0), F.length(text) - F.length(term))
    return F.when((F.length(term) == 0) | (F.length(text) < F.length(term)), F.array().cast("array<int>")).otherwise(F.filter(starts, lambda i: F.substr(text, i + 1, F.length(term)) == term))


def contains_join(left: DataFrame, text: str, terms: DataFrame, term: str, gram: int = 3) -> DataFrame:
    """left x terms where the text contains the term; terms come as ``right``, a struct. Null texts and empty terms match nothing.

    Terms within the checked size go to the workers as one multi-pattern automaton, which reads every text once. More
    terms than that meet the texts by equality of their first ``gram`` characters; every match contains those, so
    nothing is missed.
    """
    usable = terms.where(F.length(term) > 0).select(F.col(term).alias("_term"), F.struct(*terms.columns).alias("right"))
    keyed, small = broadcast_if_small(usable)
    if small and ahocorasick is not None:
        patterns = sorted({r[0] for r in usable.select("_term").collect()})
        tagged = left.withColumn("_hit", F.explode(_contained(patterns)(F.col(text))))
        return tagged.join(keyed, F.col("_hit") == F.col("_term")).drop("_hit", "_term")
    # Texts stand aside under a digest while their short runs meet the terms' heads; each text is then searched once for
    # the terms whose heads it holds.
    heads = usable.select("_term").distinct().withColumn("_head", F.substr(F.col("_term"), F.lit(1), F.least(F.lit(gram), F.length("_term"))))
    texts = left.where(F.length(text) > 0).select(F.col(text).alias("_text")).distinct().withColumn("_digest", F.sha2("_text", 256))

    def pieces(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("_text")), lambda i: F.substr(F.col("_text"), i, F.lit(n)))

    grams = F.array_distinct(F.flatten(F.array(*[pieces(n) for n in range(1, gram + 1)])))
    held = texts.select("_digest", F.explode(grams).alias("_gram")).join(heads, F.col("_gram") == F.col("_head")).groupBy(F.col("_digest").alias("_d")).agg(F.collect_set("_term").alias("_terms"))
    hits = texts.join(held, F.col("_digest") == F.col("_d")).select(F.col("_digest").alias("_of"), F.explode(F.filter("_terms", lambda t: F.contains(F.col("_text"), t))).alias("_hit"))
    return left.withColumn("_digest", F.sha2(text, 256)).join(hits, F.col("_digest") == F.col("_of")).join(usable, F.col("_hit") == F.col("_term")).drop("_digest", "_of", "_hit", "_term")


_AUTOMATA: dict[tuple[str, ...], object] = {}


def _automaton(patterns: tuple[str, ...]):
    """One automaton for a list of patterns in a worker, however many batches it reads."""
    if patterns not in _AUTOMATA:
        a = ahocorasick.Automaton()
        for p in patterns:
            a.add_word(p, p)
        a.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[patterns] = a
    return _AUTOMATA[patterns]


def _contained(patterns: list[str]):
    """An Arrow UDF: the different patterns that each text contains."""
    listed = tuple(patterns)

    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = _automaton(listed)
        for batch in texts:
            yield batch.map(lambda t: sorted({p for _, p in a.iter(t)}) if t and listed else [])

    return F.pandas_udf(find, "array<string>")


def _piece_keys(size: Column, most: int, piece) -> Column:
    """Keys of the most + 1 pieces of a term of a size: size, number and the text that ``piece`` (start, length) gives."""
    cuts = [F.floor(size * i / (most + 1)).cast("int") for i in range(most + 2)]
    key = lambda i: F.concat_ws(":", size.cast("string"), F.lit(i), piece(cuts[i], cuts[i + 1] - cuts[i]))
    return F.array(*[key(i) for i in range(most + 1)])


def term_pieces(term: Column, most: int = 2) -> Column:
    """A term's pieces. A word within ``most`` edits holds one of them unchanged, moved by at most ``most`` places."""
    return bound(term, lambda t: _piece_keys(F.length(t), most, lambda a, n: F.substr(t, a + 1, n)))


def word_pieces(word: Column, most: int = 2) -> Column:
    """What a word has where the pieces of terms of any size within ``most`` of its own would be: a number of keys that doesn't grow with the word."""

    def keys(w: Column) -> Column:
        moved = lambda by: lambda a, n: F.substr(w, F.greatest(a + by, F.lit(0)) + 1, n)
        sizes = [F.length(w) + d for d in range(-most, most + 1)]
        return F.array_distinct(F.flatten(F.array(*[F.when(s >= 0, _piece_keys(s, most, moved(by))).otherwise(F.array().cast("array<string>")) for s in sizes for by in range(-most, most + 1)])))

    return bound(word, keys)


def fuzzy_join(left: DataFrame, word: str, right: DataFrame, term: str, most: int = 2) -> DataFrame:
    """left x right within the edit distance, with ``distance`` (0 for equal); right columns as ``right``.

    Pieces of terms meet the same places of words by equality, and the true distance is checked after it: nothing is
    missed. Distinct words and terms meet, so repeats cost nothing, and the pairs join back by word and by term.
    """
    words = left.where(F.col(word).isNotNull()).select(F.col(word).alias("_word")).distinct().withColumn("_key", F.explode(word_pieces(F.col("_word"), most)))
    terms = right.where(F.col(term).isNotNull()).select(F.col(term).alias("_term")).distinct().withColumn("_k", F.explode(term_pieces(F.col("_term"), most)))
    terms, _ = broadcast_if_small(terms)
    near = words.join(terms, F.col("_key") == F.col("_k")).select("_word", "_term").distinct()
    near = near.withColumn("distance", F.levenshtein(F.col("_word"), F.col("_term"), most)).where("distance >= 0")
    pairs, _ = broadcast_if_small(materialize(near, "fuzzy-pairs"))
    whole = right.select(F.struct(*right.columns).alias("right"), F.col(term).alias("_rterm"))
    return left.join(pairs, F.col(word) == F.col("_word")).join(whole, F.col("_term") == F.col("_rterm")).select(*left.columns, "right", "distance")


def nearest_hashes(left: DataFrame, right: DataFrame, n: int, most_aspect: float, left_block: int = 2_000, right_block: int = 8_192) -> DataFrame:
    """left_id, right_id, bits: for every left row the n right ones of another id with fewest differing bits, then least id.

    Both sides have id (unique), p, d (64 bits each, as longs) and aspect, none null; aspects may differ by a factor of
    ``most_aspect``. Any distance counts, so all pairs are looked at: every block of one side meets every block of the
    other, and only the best n of a row leave a block.
    """
    from math import ceil

    spark = left.sparkSession
    cores = spark.sparkContext.defaultParallelism
    lefts, rights = max(1, ceil(left.count() / left_block)), max(cores, ceil(right.count() / right_block))
    tasks = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def blocks(df: DataFrame, own: str, of: int, other: str, others: int) -> DataFrame:
        placed = df.select("id", "p", "d", "aspect", F.pmod(F.xxhash64("id"), F.lit(of)).cast("int").alias(own))
        # With a number of partitions: the blocks are few bytes but much work, so they mustn't be coalesced.
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).repartition(tasks, "lb", "rb")

    pairs = blocks(left, "lb", lefts, "rb", rights).groupBy("lb", "rb").cogroup(blocks(right, "rb", rights, "lb", lefts).groupBy("lb", "rb"))
    found = pairs.applyInArrow(_nearest_in_block(n, most_aspect), "left_id long, right_id long, bits int")
    w = Window.partitionBy("left_id").orderBy("bits", "right_id")
    return found.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def _nearest_in_block(n: int, most_aspect: float):
    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        a, b = ({c: t[c].to_numpy() for c in ("id", "p", "d", "aspect")} for t in (left, right.sort_by("id")))
        ids, entries, bits = [], [], []
        for at in range(0, len(a["id"]) if len(b["id"]) else 0, 256):
            row = {c: v[at : at + 256, None] for c, v in a.items()}
            far = sum(np.bitwise_count(row[c].view(np.uint64) ^ b[c].view(np.uint64)).astype(np.int64) for c in "pd")
            ok = (row["id"] != b["id"]) & (np.maximum(row["aspect"], b["aspect"]) <= np.minimum(row["aspect"], b["aspect"]) * most_aspect)
            # Bits, then place by id, in one number; pairs that don't count come after all others.
            order = np.where(ok, far, 1_000) * len(b["id"]) + np.arange(len(b["id"]))
            best = np.argpartition(order, min(n, order.shape[1]) - 1, axis=1)[:, :n]
            used = np.take_along_axis(ok, best, 1)
            ids.append(np.broadcast_to(row["id"], best.shape)[used])
            entries.append(b["id"][best][used])
            bits.append(np.take_along_axis(far, best, 1)[used])
        whole = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"left_id": whole(ids, pa.int64()), "right_id": whole(entries, pa.int64()), "bits": whole(bits, pa.int32())})

    return find


def either_join(left: DataFrame, key: str, edges: DataFrame, a: str, b: str) -> DataFrame:
    """left x edges with an endpoint equal to the key: two equi-joins instead of a join on OR; an edge counts once."""
    e = edges.select(F.struct(*edges.columns).alias("right"), F.array_distinct(F.array(a, b)).alias("_ends"))
    e, _ = broadcast_if_small(e.withColumn("_end", F.explode("_ends")).drop("_ends"))
    return left.join(e, F.col(key) == F.col("_end")).drop("_end")


def not_inside(spans: DataFrame, keys: Sequence[str], start: str, end: str, covers: DataFrame, cover_start: str, cover_end: str) -> DataFrame:
    """Spans that no cover of the same keys contains (a <= start and end <= b)."""
    c = covers.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(cover_start).alias("_a"), F.col(cover_end).alias("_b"))
    same = (F.col("_a") <= F.col(start)) & (F.col(end) <= F.col("_b"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return spans.join(c, same, "left_anti")


def member_join(left: DataFrame, array: str, right: DataFrame, key: str) -> DataFrame:
    """left x right with the right key in the left array; right columns as ``right``. Repeated members count once."""
    r = right.select(F.col(key).alias("_member"), F.struct(*right.columns).alias("right"))
    return left.withColumn("_item", F.explode(F.array_distinct(array))).join(r, F.col("_item") == F.col("_member")).drop("_item", "_member")
