"""A registry of extractors: named, versioned Column functions over the rows of a frame, which users extend.

An extractor takes a context (whatever the caller passes: lists, thresholds, a clock) and gives a Column. All that apply to
a row are evaluated in one projection, so a text is read by one stage however many extractors there are. One that fails to
build, or whose expression the frame can't resolve, doesn't take the others with it: it comes out as an error.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Extractor:
    name: str
    version: str
    make: Callable[[Mapping], Column]
    #: A condition on rows it is for; null where it doesn't hold.
    applies: Callable[[Mapping], Column] | None = None


@dataclass
class Extractors:
    """``register`` is a decorator; ``apply`` adds a struct of all extractors' results."""

    known: dict[str, Extractor] = field(default_factory=dict)

    def register(self, name: str, version: str, applies: Callable[[Mapping], Column] | None = None):
        """Register a function of the context under a name; a name is taken once."""

        def keep(make: Callable[[Mapping], Column]) -> Callable[[Mapping], Column]:
            if name in self.known:
                raise ValueError(f"extractor {name!r} is registered already")
            self.known[name] = Extractor(name, version, make, applies)
            return make

        return keep

    def versions(self) -> dict[str, str]:
        return {n: e.version for n, e in sorted(self.known.items())}

    def apply(self, rows: DataFrame, context: Mapping | None = None, out: str = "facts") -> tuple[DataFrame, dict[str, str]]:
        """(rows with the struct ``out``: a field for each extractor that works, in order of names; errors by name)."""
        context, good, errors = context or {}, [], {}
        for name, e in sorted(self.known.items()):
            try:
                column = e.make(context)
                column = column if e.applies is None else F.when(e.applies(context), column)
                rows.select(column.alias(name)).schema  # noqa: B018  (analysis only)
            except AnalysisException as x:
                errors[name] = f"{x.getCondition() or type(x).__name__}"
            except Exception as x:  # noqa: BLE001  (an extractor is foreign code)
                errors[name] = f"{type(x).__name__}: {x}"[:500]
            else:
                good.append(column.alias(name))
        return rows.withColumn(out, F.struct(*good) if good else F.lit(None)), errors


def of_texts() -> Extractors:
    """The extractors that this library brings for a column ``text``."""
    from lookout.functions import claims, text

    made = Extractors()
    made.register("payments", "1")(lambda c: claims.payments(F.col("text")))
    made.register("commerce", "1")(lambda c: claims.commerce(F.col("text")))
    made.register("editorial", "1")(lambda c: claims.editorial(F.col("text")))
    made.register("official", "1")(lambda c: claims.official_claims(text.sentences(F.col("text"))))
    return made
