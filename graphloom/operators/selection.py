"""The address-pattern language over catalogs of targets, labels and graph roots.

``pkg:name`` names one address, ``pkg`` a package, ``pkg/...`` a package and all below. ``//`` starts
at the root, anything else at the caller's package. Patterns are parsed on the driver and become
equality or prefix predicates, which reach the Parquet scan (a regular expression would not).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SelectorError(ValueError):
    pass


@dataclass(frozen=True)
class Selector:
    """``name`` is set for an exact address; the root package is the empty string."""

    package: str
    name: str | None = None
    recursive: bool = False

    @property
    def address(self) -> str:
        return f"//{self.package}:{self.name}"

    def matches(self, column: str = "address") -> Column:
        address = F.col(column)
        if self.name is not None:
            return address == self.address
        if not self.recursive:
            return address.startswith(f"//{self.package}:")
        return address.startswith("//") if not self.package else address.startswith(f"//{self.package}:") | address.startswith(f"//{self.package}/")

    def matches_root(self) -> Column:
        """Graph roots: a default one has no name, so its package is its whole address and no exact pattern names it."""
        address, is_default = F.col("address"), F.col("is_default")
        if self.name is not None:
            return ~is_default & (address == self.address)
        whole = f"//{self.package}"
        if not self.recursive:
            return F.when(is_default, address == whole).otherwise(address.startswith(f"{whole}:"))
        below = address.startswith(f"{whole}/" if self.package else "//")
        return below | F.when(is_default, address == whole).otherwise(address.startswith(f"{whole}:"))


def normalize_package(package: str, selector: str, base: str = "") -> str:
    """A package from the root; ``..`` may not leave it."""
    if package.startswith("//"):
        parts, package = [], package[2:]
        if package.startswith("/"):
            raise SelectorError(f"{selector}: a package does not begin with / after //")
    elif package.startswith("/"):
        raise SelectorError(f"{selector}: a package begins with // or is relative")
    else:
        parts = [p for p in base.split("/") if p]
    for part in package.split("/"):
        if part == "...":
            raise SelectorError(f"{selector}: ... ends a pattern")
        if part == "..":
            if not parts:
                raise SelectorError(f"{selector}: leaves the workspace root")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


def parse(selector: str, base: str = "") -> Selector:
    """A pattern, seen from the package ``base``."""
    if not selector:
        raise SelectorError("an empty pattern")
    package, colon, name = selector.partition(":")
    if colon:
        if not name or ":" in name or "/" in name:
            raise SelectorError(f"{selector}: not a target name")
        return Selector(normalize_package(package or ".", selector, base), name)
    if selector in ("...", "//..."):
        return Selector("" if selector[0] == "/" else base, recursive=True)
    if selector.endswith("/..."):
        return Selector(normalize_package(selector[:-4] or "//", selector, base), recursive=True)
    return Selector(normalize_package(selector, selector, base))


def split_facet(selector: str) -> tuple[str, str | None]:
    target, at, facet = selector.rpartition("@")
    if not at:
        return selector, None
    if not target or not facet or set(facet) & set("/:#@"):
        raise SelectorError(f"{selector}: not a facet")
    return target, facet


def any_of(selectors: list[str], base: str = "") -> Column:
    out = F.lit(False)
    for s in selectors:
        out = out | parse(s, base).matches()
    return out


def ordinal(selectors: list[str], base: str = "", last: bool = False) -> Column:
    """The place of the first (or last) pattern that matches, else null; one pass for all patterns."""
    places = list(enumerate(parse(s, base).matches() for s in selectors))
    out = F.lit(None).cast("int")
    for i, matches in places if last else reversed(places):
        out = F.when(matches, F.lit(i)).otherwise(out)
    return out


def select_targets(targets: DataFrame, selectors: list[str], base: str = "") -> DataFrame:
    return targets.where(any_of(selectors, base)).dropDuplicates(["address"])


def unmatched(targets: DataFrame, selectors: list[str], base: str = "") -> DataFrame:
    """Patterns that match nothing (an error for the caller): one pass, one row per pattern."""
    counts = targets.agg(*(F.count_if(parse(s, base).matches()).alias(str(i)) for i, s in enumerate(selectors)))
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("selector"), F.col(str(i)).alias("n")) for i, s in enumerate(selectors))))
    return counts.select(rows.alias("x")).select("x.*").where("n = 0").select("selector")


def goal_roots(targets: DataFrame, products: DataFrame, requests: list[tuple[str, str]], base: str = "") -> DataFrame:
    """Targets with the product asked for; of several patterns the last decides. ``requests``: pattern and product."""
    named = targets
    wanted = F.lit(None).cast("string")
    for selector, product in requests:
        of = parse(selector, base).matches()
        kinds = products.where(F.col("product") == product).select("kind").distinct().withColumn(f"_has_{product}", F.lit(True))
        if f"_has_{product}" not in named.columns:
            # a few rows: the registry of kinds, not data
            named = named.join(kinds, "kind", "left")
        wanted = F.when(of & F.col(f"_has_{product}"), F.lit(product)).otherwise(wanted)
    return named.withColumn("product", wanted).where("product is not null").select("address", "kind", "product")


def select_labels(labels: DataFrame, selectors: list[str], handlers: DataFrame | None = None, goal: str | None = None, base: str = "") -> DataFrame:
    """One row per label id: the first address by pattern, then by address; with ``goal``, only ids with a handler."""
    found = labels.withColumn("_at", ordinal(selectors, base)).where("_at is not null")
    if handlers is not None:
        found = found.join(handlers.where(F.col("goal") == goal).select("id").distinct(), "id", "left_semi")
    return found.groupBy("id").agg(F.min_by("address", F.struct("_at", "address")).alias("address"))


def changed_scope(changed: DataFrame, labels: DataFrame, selectors: list[str], base: str = "") -> DataFrame:
    """Changed addresses within the patterns (all, if there are none); an alias that matches stands for its primary address."""
    if not selectors:
        return changed.select("address").distinct()
    primary = labels.where("is_primary").select("id", F.col("address").alias("primary"))
    through = labels.where(any_of(selectors, base)).join(primary, "id").select(F.col("primary").alias("address"))
    return changed.where(any_of(selectors, base)).select("address").unionByName(changed.join(through, "address", "left_semi").select("address")).distinct()


def select_roots(roots: DataFrame, selector: str, workflow: str | None = None, base: str = "") -> DataFrame:
    """Graph roots; for a package pattern, default roots hide the others of their workflow. ``workflow`` None: each by itself."""
    target, facet = split_facet(selector)
    of = parse(target, base)
    found = roots.where(of.matches_root())
    if workflow is not None:
        found = found.where(F.col("workflow") == workflow)
    if facet is not None:
        found = found.where(F.col("facet") == facet)
    if of.name is None and not of.recursive:
        defaults = found.groupBy("workflow").agg(F.max("is_default").alias("_some"))
        found = found.join(defaults, "workflow").where("is_default or not _some").drop("_some")
    return found.dropDuplicates(["address", "workflow", "facet"]).select("address", "workflow", "facet")
