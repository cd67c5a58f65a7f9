"""Aggregations over forms and over the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import inventory as I
from ..functions import text as X


def symbol_table(spark: SparkSession) -> DataFrame:
    """(symbol, ordinal, features) of the inventory, defaults filled in."""
    return spark.createDataFrame([(s, i, b) for i, (s, b) in enumerate(I.full().items())], "symbol string, ordinal int, features map<string,string>")


def feature_table(spark: SparkSession) -> DataFrame:
    """(symbol, feature, value, stated)."""
    rows = [(s, f, v, f in I.stated()[s]) for s, b in I.full().items() for f, v in b.items()]
    return spark.createDataFrame(rows, "symbol string, feature string, value string, stated boolean")


def feature_counts(spark: SparkSession) -> DataFrame:
    """(feature, value, n): symbols by feature value."""
    return feature_table(spark).groupBy("feature", "value").agg(F.count("*").alias("n"))


def feature_usage(spark: SparkSession) -> DataFrame:
    """(feature, n): symbols that state each declared feature, with 0 for those that none states."""
    declared = spark.createDataFrame([(f,) for f in I.values()], "feature string")
    used = feature_table(spark).where("stated").groupBy("feature").agg(F.count("*").alias("n"))
    return declared.join(F.broadcast(used), "feature", "left").select("feature", F.coalesce("n", F.lit(0)).alias("n"))


def natural_class(units: list[str], with_defaults: bool = True) -> dict[str, str]:
    """Features that all the units share; a unit that can't be read is refused, as the rest would speak for it."""
    bundles = [I.stated().get(u) if not with_defaults and u in I.stated() else I.bundle_of(u) for u in units]
    if bad := [u for u, b in zip(units, bundles, strict=True) if not b]:
        raise ValueError(f"can't read {' '.join(bad)}")
    return {f: v for f, v in sorted(bundles[0].items()) if all(b.get(f) == v for b in bundles)} if bundles else {}


def value_distances(spark: SparkSession) -> DataFrame:
    """(feature, v1, v2, d) of all values of a feature."""
    return spark.createDataFrame([(f, a, b, I.value_distance(f, a, b)) for f, vs in I.values().items() for a in vs for b in vs], "feature string, v1 string, v2 string, d double")


def hierarchy(symbols: list[str], order: list[str] | None = None, depth: int = 0) -> list[tuple[int, str, list[str]]]:
    """(depth, label, members) of a tree that splits by the first feature of which the members have two values; members without
    it are a branch of their own, but having it or not is no reason to split."""
    out = []
    if len(symbols) < 2:
        return out
    rest = order if order is not None else list(I.values())
    for f in rest:
        groups: dict[str, list[str]] = {}
        for s in symbols:
            groups.setdefault(I.full()[s].get(f, ""), []).append(s)
        if len(groups.keys() - {""}) > 1:
            for v in sorted(groups):
                out.append((depth, f"{f}={v or 'none'}", groups[v]))
                out += hierarchy(groups[v], [x for x in rest if x != f], depth + 1)
            break
    return out


def unit_counts(df: DataFrame, form_col: str) -> DataFrame:
    """(unit, n): units of all forms, without prosody. Counts are combined before the shuffle."""
    return df.select(F.explode(X.units(F.col(form_col))).alias("u")).select(X.bare(F.col("u")).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))


def feature_profile(df: DataFrame, form_col: str, feature: str) -> DataFrame:
    """(value, n): values of a feature over all units of all forms: counts by unit first, then a join with the inventory."""
    dim = feature_table(df.sparkSession).where(F.col("feature") == feature).select(F.col("symbol").alias("unit"), "value")
    return unit_counts(df, form_col).join(F.broadcast(dim), "unit").groupBy("value").agg(F.sum("n").alias("n"))


def integrity(bundles: dict[str, dict[str, str]] | None = None) -> list[tuple[str, str]]:
    """(symbol, problem) of an inventory: unknown values, speech without a manner, consonants without a place, equal bundles."""
    own = bundles if bundles is not None else I.full()
    out, seen = [], {}
    for s, b in own.items():
        out += [(s, f"unknown value {f}={v}") for f, v in b.items() if v not in I.values().get(f, ())]
        if "manner" not in b:
            out.append((s, "no manner"))
        elif b["manner"] not in ("vowel", "silence") and "place" not in b:
            out.append((s, "no place"))
        key = tuple(sorted(b.items()))
        if key in seen:
            out.append((s, f"same features as {seen[key]}"))
        seen.setdefault(key, s)
    return out


def supplemented(extra: dict[str, dict[str, str]]) -> dict[str, dict[str, str]]:
    """The inventory with more symbols; refuses to restate one."""
    if known := set(extra) & set(I.full()):
        raise ValueError(f"already declared: {' '.join(sorted(known))}")
    return I.full() | {s: I.DEFAULTS | b for s, b in extra.items()}


def hierarchy_text(symbols: list[str]) -> str:
    return "\n".join(f"{'  ' * d}{label}: {' '.join(members)}" for d, label, members in hierarchy(symbols))


def hierarchy_dot(symbols: list[str]) -> str:
    lines, path = [], ["all"]
    for d, label, _ in hierarchy(symbols):
        path = path[: d + 1]
        lines.append(f'"{"/".join(path)}" -> "{"/".join([*path, label])}";')
        path.append(label)
    return "digraph {\n" + "\n".join(lines) + "\n}"


def shorts() -> dict[tuple[str, str], str]:
    """A short code for each feature value: the shortest prefix of feature and of value that tells it from the others."""
    out: dict[tuple[str, str], str] = {}
    taken: set[str] = set()
    for f, vs in I.values().items():
        for v in vs:
            n = 1
            while (code := f"{f[:n]}{v[:n]}") in taken and n < len(f) + len(v):
                n += 1
            code = code if code not in taken else f"{f}={v}"
            taken.add(code)
            out[f, v] = code
    return out


def features_to_shorts(bundle: dict[str, str]) -> list[str]:
    return sorted(shorts()[f, v] for f, v in bundle.items())


def shorts_to_features(codes: list[str]) -> dict[str, str]:
    back = {c: k for k, c in shorts().items()}
    return dict(back[c] for c in codes)


def glottal_aperture(bundle: dict[str, str]) -> float | None:
    """How open the glottis is, 0 closed to 1 open; None for silence."""
    if bundle.get("manner") == "silence":
        return None
    if bundle.get("place") == "glottal" and bundle.get("manner") == "plosive":
        return 0.0
    return {"creaky": 0.1, "breathy": 0.6}.get(bundle.get("phonation", ""), 0.3 if bundle.get("voiced") == "+" else 1.0)


def velic_aperture(bundle: dict[str, str]) -> float:
    return 1.0 if bundle.get("manner") == "nasal" or bundle.get("nasalized") == "+" else (0.5 if bundle.get("release") == "nasal" else 0.0)


def constrictions(bundle: dict[str, str]) -> list[tuple[str, float, float]]:
    """(place, arc, weight), front to back: primary ones weigh 1, secondary ones less."""
    own = [(p, I.PLACES[p], 1.0) for p in bundle.get("place", "").split("^") if p in I.PLACES]
    own += [(p, I.PLACES[p], I.SECONDARY_WEIGHT) for f, p in I.SECONDARY.items() if bundle.get(f) == "+"]
    return sorted(own, key=lambda c: c[1])


def summary(spark: SparkSession) -> DataFrame:
    """(what, n): sizes of the inventory."""
    own = [("phones", len(I.phones())), ("features", len(I.values())), ("values", sum(map(len, I.values().values()))), ("diacritics", len(I.DIACRITICS)), ("prosody", len(I.PROSODY)), ("vowels", sum(b["manner"] == "vowel" for b in I.stated().values()))]
    return spark.createDataFrame(own, "what string, n int")


def feature_values(feature: str) -> tuple[str, ...]:
    return I.values().get(feature, ())


def feature_applies(feature: str, unit: str) -> bool:
    """Whether a unit has a feature, stated or by default."""
    return feature in (I.bundle_of(unit) or {})


def consonant_manners() -> list[str]:
    return [m for m in I.values()["manner"] if m not in ("vowel", "silence")]


def declaring_mark(feature: str, value: str) -> str | None:
    """The first diacritic or prosodic mark that states a value; None if none does."""
    own = [m for m, d in I.DIACRITICS.items() if d.get(feature) == value] + [m for m, (f, v) in I.PROSODY.items() if (f, v) == (feature, value)]
    return own[0] if own else None


def modifier_mode(mark: str) -> str:
    """What kind of thing a mark states: prosodic, release, secondary, overriding or additive; structural for ties and boundaries."""
    if mark in I.PROSODY:
        return "prosodic"
    stated = I.DIACRITICS.get(mark)
    if stated is None:
        return "structural"
    return "release" if "release" in stated else "secondary" if stated.keys() & I.SECONDARY.keys() else "overriding" if stated.keys() & {"voiced", "place", "airstream"} else "additive"


def boundary_level(mark: str) -> str | None:
    return I.BOUNDARIES.get(mark)


def secondary_marks(bundle: dict[str, str]) -> list[str]:
    """Secondary articulations that a bundle has."""
    return [f for f in I.SECONDARY if bundle.get(f) == "+"]
