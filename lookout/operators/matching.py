"""Tiered matching of DNS names against a registry, in Arrow batches on workers that hold the registry as an automaton.

One automaton holds every needle: keywords, forms of known domains, exclusion words, context terms. Each form of a name is
read once; what follows is bookkeeping over the few hits. Edit distance goes through the thirds of the keywords in a second
automaton, so no name is compared with every keyword.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.functions import names
from lookout.session import spread
from lookout.sources.registry import Registry

MATCHER_VERSION = "1"
#: Fixed values of the matching rules.
FUZZY_LEAST_CHARS, FUZZY_MOST_EDITS = 6, 2
STRONG_HITS = ("keyword", "official_lookalike")
STATUS_LABELS = {"legacy-unverified": "legacy_whitelist_unverified", "candidate": "official_domain_candidate"}

#: The forms in which high-tier keywords are sought, in order: the reason they give, a form of the name, and
#: the characters that go from it.
FORMS = (
    ("substring", "plain", ""), ("folded", "plain", "-"), ("folded", "plain", "-."), ("homoglyph", "skeleton", ""),
    ("homoglyph", "folded", ""), ("homoglyph", "folded", "."), ("homoglyph", "residue", ""), ("homoglyph", "residue", "."),
)

HIT = "struct<type:string,keyword:string,brand:string,tier:string,reason:string,start:int,end:int,distance:int,part:string,context:array<string>,status:string>"
SCHEMA = f"host string, unicode_host string, registrable_domain string, candidate boolean, strength string, suppressed_by string, hits array<{HIT}>, labels array<string>, notes array<string>"
_HIT_KEYS = ("type", "keyword", "brand", "tier", "reason", "start", "end", "distance", "part", "context", "status")
Span = tuple[int, int]


def _hit_order(h: dict) -> tuple:
    return h["type"], h["keyword"], h.get("start", -1), h.get("end", -1), h.get("reason") or ""


def edits(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1] if row[-1] <= most else None


def thirds(word: str) -> list[tuple[str, int]]:
    """Pieces of a word with their starts; one of them stands unchanged in any text at two edits, moved by at most two."""
    n = FUZZY_MOST_EDITS + 1
    cuts = [len(word) * i // n for i in range(n + 1)]
    return [(word[a:b], a) for a, b in zip(cuts, cuts[1:])]


class NameMatcher:
    """match(name) -> dict of SCHEMA's fields, or None for what is no DNS name."""

    def __init__(self, registry: Registry):
        self.registry = registry

    def __getstate__(self):
        return {"registry": self.registry}

    @cached_property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.registry.lists, sort_keys=True, default=str).encode()).hexdigest()[:16]

    @cached_property
    def _tables(self) -> dict:
        r = self.registry
        live = {b["id"] for b in r.rows("brands")}
        words = [k for k in r.rows("keywords") if k["brand"] in live]
        by_term = {k["term"]: [] for k in words}
        for e in r.rows("exclusions"):
            by_term.get(e["scope"], []).append(e["term"])
        domains = {d["name"]: d for d in r.rows("domains")}
        likes: dict[str, list[dict]] = {}
        for d in domains.values():
            skel = (names.normalized(d["name"]) or {"skeleton": d["name"]})["skeleton"]
            for form in {skel, skel.replace(".", "-"), skel.replace(".", "")}:
                likes.setdefault(form, []).append(d)
        near: dict[str, list[tuple[int, dict]]] = {}
        for k in words:
            if (k.get("fuzzy") or k["tier"] == "high") and len(k["term"]) > FUZZY_MOST_EDITS:
                for piece, start in thirds(k["term"]):
                    near.setdefault(piece, []).append((start, k))
        suppressing = {n: d["kind"] == "official" for n, d in domains.items() if d.get("suppresses") and d["status"] == "confirmed"}
        context = sorted({c["term"] for c in r.rows("context_terms")})
        needles = {*by_term, *likes, *context, *(x for xs in by_term.values() for x in xs)} - {""}
        tier = lambda t: {term: [k for k in words if k["term"] == term and k["tier"] == t] for term in {k["term"] for k in words if k["tier"] == t}}
        sizes = [len(k["term"]) for k in words if k.get("fuzzy") or k["tier"] == "high"] or [0]
        return {"high": tier("high"), "low": tier("low"), "near_chars": (min(sizes) - FUZZY_MOST_EDITS, max(sizes) + FUZZY_MOST_EDITS), "exclusions": by_term, "domains": domains, "likes": likes, "near": near, "suppressing": suppressing, "context": context, "needles": needles}

    @cached_property
    def _automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for n in self._tables["needles"]:
            a.add_word(n, n)
        a.make_automaton()
        return a

    @cached_property
    def _pieces(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for piece, owners in self._tables["near"].items():
            a.add_word(piece, (len(piece), owners))
        if not len(a):
            a.add_word("\x00", (1, []))
        a.make_automaton()
        return a

    def _spans(self, text: str, memo: dict[str, dict[str, list[Span]]]) -> dict[str, list[Span]]:
        found = memo.get(text)
        if found is None:
            found = memo[text] = {}
            if self._tables["needles"]:
                for end, n in self._automaton.iter(text):
                    found.setdefault(n, []).append((end + 1 - len(n), end + 1))
        return found

    def _excluding(self, term: str, span: Span, spans: dict[str, list[Span]]) -> str | None:
        """The exclusion word of the term that holds the span, if any."""
        return next((x for x in self._tables["exclusions"][term] for a, b in spans.get(x, ()) if a <= span[0] and span[1] <= b), None)

    def _above(self, host: str) -> list[str]:
        """The host and its parents, longest first."""
        labels = host.split(".")
        return [".".join(labels[i:]) for i in range(len(labels))]

    def match(self, name: str | None) -> dict | None:
        n = names.normalized(name)
        if n is None:
            return None
        read = _Read(self, n)
        owner, suppressed = self._owners(n)
        hits = [{"type": "registry_domain", "keyword": owner["name"], "brand": owner["brand"], "status": owner["status"]}] if owner and owner["name"] != suppressed else []
        hits += self._lookalikes(n, read)
        hits += self._keywords(read)
        hits += self._near(n, {h["keyword"] for h in hits})
        hits += self._tokens(read, [f"brand:{h['keyword']}" for h in hits if h["type"] in (*STRONG_HITS, "fuzzy")])
        kinds = {h["type"] for h in hits}
        strength = None if suppressed or not kinds else "strong" if kinds & set(STRONG_HITS) else "weak"
        notes = read.notes | {k for k in ("wildcard", "idn", "idn_invalid") if n[k]} | ({"suppressed:official_domain"} if suppressed else set())
        return {
            **{k: n[k] for k in ("host", "unicode_host", "registrable_domain")},
            "candidate": strength is not None,
            "strength": strength,
            "suppressed_by": suppressed,
            "hits": [{k: h.get(k) for k in _HIT_KEYS} | {"context": list(h.get("context", ()))} for h in sorted(hits, key=_hit_order)],
            "labels": sorted({STATUS_LABELS[h["status"]] for h in hits if h.get("status") in STATUS_LABELS}),
            "notes": sorted(notes),
        }

    def _owners(self, n: dict) -> tuple[dict | None, str | None]:
        """The most specific known domain at or above the host, and the domain that suppresses it: an official one above, any other only if it is the host."""
        parents, t = self._above(n["host"]), self._tables
        owner = next((t["domains"][p] for p in parents if p in t["domains"]), None)
        return owner, next((p for p in parents if t["suppressing"].get(p) or (p in t["suppressing"] and p == n["host"])), None)

    def _lookalikes(self, n: dict, read: _Read) -> list[dict]:
        """Known domains written inside other names, between characters that are no letters or digits; one hit a domain."""
        edge = lambda text, i: i < 0 or i >= len(text) or not text[i].isalnum()
        best: dict[str, tuple] = {}
        parents = set(self._above(n["host"]))
        for place, text in enumerate((n["skeleton"], n["residue"])):
            for form, spans in read.spans(text).items():
                owners = self._tables["likes"].get(form, ())
                span = next((s for s in spans if edge(text, s[0] - 1) and edge(text, s[1])), None) if owners else None
                if span:
                    for d in owners:
                        if d["name"] not in parents:
                            offer = (form, place, span)
                            best[d["name"]] = min(best.get(d["name"], offer), offer)
        return [{"type": "official_lookalike", "keyword": d, "brand": self._tables["domains"][d]["brand"], "reason": "substring" if form in n["plain"] else "homoglyph", "start": span[0], "end": span[1]} for d, (form, _, span) in best.items()]

    def _keywords(self, read: _Read) -> list[dict]:
        """High-tier keywords: of all places where a keyword stands, in the order of FORMS and of the form, the first that no exclusion holds."""
        places: dict[str, list[tuple[str, Span, str | None]]] = {}
        for reason, spans in read.forms():
            for term in filter(self._tables["high"].__contains__, spans):
                places.setdefault(term, []).extend((reason, s, self._excluding(term, s, spans)) for s in spans[term])
        out = []
        for term, every in places.items():
            free = next((i for i, (_, _, by) in enumerate(every) if by is None), len(every))
            read.notes.update(f"excluded:{by}" for _, _, by in every[:free])
            for reason, (start, end), _ in every[free : free + 1]:
                out += [{"type": "keyword", "keyword": term, "brand": k["brand"], "tier": "high", "reason": reason, "start": start, "end": end} for k in self._tables["high"][term]]
        return out

    def _near(self, n: dict, taken: set[str]) -> list[dict]:
        """Keywords at one or two edits from a part of the name; the closest, then first part. Not fuzzy ones only meet parts with other characters."""
        shortest, longest = self._tables["near_chars"]
        parts = {p for label in n["skeleton"].split(".") for p in (label.replace("-", ""), *label.split("-")) if max(FUZZY_LEAST_CHARS, shortest) <= len(p) <= longest}
        best: dict[str, tuple] = {}
        for p in parts:
            offers = {}
            for end, (width, owners) in self._pieces.iter(p):
                at = end + 1 - width
                for start, k in owners:
                    if abs(at - start) <= FUZZY_MOST_EDITS and abs(len(p) - len(k["term"])) <= FUZZY_MOST_EDITS:
                        offers[k["term"]] = k
            for term, k in offers.items():
                if term not in taken and (k.get("fuzzy") or not p.isascii()):
                    d = edits(p, term, FUZZY_MOST_EDITS)
                    if d:
                        best[term] = min(best.get(term, (d, p, k["brand"], k["tier"])), (d, p, k["brand"], k["tier"]))
        return [{"type": "fuzzy", "keyword": term, "brand": b, "tier": tier, "distance": d, "part": p} for term, (d, p, b, tier) in best.items()]

    def _tokens(self, read: _Read, brands: list[str]) -> list[dict]:
        """Low-tier keywords, a hit for each place: a token if it is a word, an affix inside one where a brand or context term stands too."""
        text, spans = read.n["skeleton"], read.spans(read.n["skeleton"])
        low = [k for term in spans for k in self._tables["low"].get(term, ())]
        beside = [c for c in self._tables["context"] if c in read.spans(read.n["folded"])] if low else []
        out = []
        for k, (start, end) in ((k, s) for k in low for s in spans[k["term"]]):
            by = self._excluding(k["term"], (start, end), spans)
            context = sorted(brands) + [c for c in beside if c != k["term"]]
            word = not (text[max(0, start - 1) : start].isalpha() or text[end : end + 1].isalpha())
            if by is not None or not (word or context):
                read.notes.add(f"{k['term']}_affix_uncontexted" if by is None else f"excluded:{by}")
            else:
                out.append({"type": "token" if word else "affix", "keyword": k["term"], "brand": k["brand"], "tier": "low", "start": start, "end": end, "context": context})
        return out


class _Read:
    """A name's forms, each read once by the automaton, and the notes that come up."""

    def __init__(self, matcher: NameMatcher, n: dict):
        self.n, self.notes, self._matcher, self._memo = n, set(), matcher, {}

    def spans(self, text: str) -> dict[str, list[Span]]:
        return self._matcher._spans(text, self._memo)

    def forms(self) -> Iterator[tuple[str, dict[str, list[Span]]]]:
        for reason, form, gone in FORMS:
            text = self.n[form]
            for c in gone:
                text = text.replace(c, "")
            if found := self.spans(text):
                yield reason, found


def match_names(rows: DataFrame, name: str, registry: Registry, out: str = "match") -> DataFrame:
    """Adds the struct ``out`` (SCHEMA); all null for what is no DNS name. Works on batch and streaming frames."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    matcher, kind = NameMatcher(registry), to_arrow_type(T._parse_datatype_string(SCHEMA))
    none = dict.fromkeys(f.name for f in kind)

    def batches(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for names_ in it:
            known: dict = {}
            yield pa.array([known[x] if x in known else known.setdefault(x, matcher.match(x) or none) for x in names_.to_pylist()], kind)

    return spread(rows).withColumn(out, F.arrow_udf(batches, SCHEMA).asNondeterministic()(F.col(name)))


def to_json_line(match: str = "match"):
    """A match as one JSON line with sorted keys and ASCII only."""

    def lines(m: pd.DataFrame) -> pd.Series:
        rows = m.to_dict("records")
        return pd.Series([json.dumps(_plain(r), sort_keys=True, ensure_ascii=True, separators=(",", ":")) for r in rows])

    return F.pandas_udf(lines, "string")(F.col(match))


def _plain(x):
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items() if v is not None}
    return [_plain(v) for v in x] if hasattr(x, "__iter__") and not isinstance(x, str) else x
