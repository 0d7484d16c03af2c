"""The verdict of a pair as one expression: two axes of evidence, never averaged, and four rules that cap it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.bits import let
from kindred.functions.ints import SCALE, _long, idiv

CHANNELS = ("local", "shape", "topology", "runs", "dct", "palette", "silhouette")
#: Codes of the verdicts.
STATES = {"Unrelated": 0, "Related": 1, "Suspected": 2, "Copy": 3, "Identical": 4, "Indeterminate": 5, "NotCopy": 6}


@dataclass(frozen=True)
class Calibration:
    """Parameters of the rules. The defaults are fixed values of the calibration in use."""

    name: str = "CAL-007-PROVISIO"
    strong: int = 4000
    moderate: int = 3300
    weak: int = 1000
    solo: int = 6000
    geo_strong: int = 3500
    geo_weak: int = 1200
    geo_solo_inliers: int = 11
    topology_dominant: int = 6000
    min_secondaries: int = 3
    coverage_floor: int = 2500
    repetition: int = 1500
    weights: dict[str, int] = field(default_factory=lambda: dict(zip(CHANNELS, (35, 25, 15, 10, 10, 5, 10), strict=True)))
    luts: dict[str, tuple[tuple[int, int], ...]] = field(
        default_factory=lambda: {
            "local": ((0, 0), (5000, 1000), (8800, 4200), (9400, 8800), (10000, 10000)),
            "geometry": ((0, 0), (1900, 1100), (3000, 3000), (10000, 10000)),
            "runs": ((0, 0), (9100, 900), (9700, 4500), (10000, 10000)),
            "palette": ((0, 0), (3000, 800), (6500, 4000), (10000, 10000)),
            "geo_diversity": ((0, 6000), (2000, 8000), (4000, 10000), (10000, 10000)),
        }
    )


CURRENT = Calibration()
FORMER = replace(CURRENT, name="CAL-004-PROPOSED", moderate=2400)


def weighted_structure(values: dict[str, tuple[Column, Column]], c: Calibration = CURRENT) -> Column:
    """The mean of the channels that could be measured, weighted; 0 if none could."""
    total = sum((F.when(m, _long(v) * c.weights[k]).otherwise(0) for k, (v, m) in values.items()), F.lit(0))
    weight = sum((F.when(m, c.weights[k]).otherwise(0) for k, (_, m) in values.items()), F.lit(0))
    return idiv(total, weight)


def verdict(
    values: dict[str, tuple[Column, Column]],
    *,
    identical: Column,
    geo_measurable: Column,
    geo_evidence: Column,
    inliers: Column,
    topology_class: Column,
    diversity: Column,
    coverage: Column,
    mirrored: Column,
    c: Calibration = CURRENT,
) -> Column:
    """A struct ``state, code, class, basis, structural, certifiable`` of the evidence; ``values`` has (value, measurable) by channel."""
    local = values["local"][1]
    secondaries = sum((F.when(m, 1).otherwise(0) for k, (_, m) in values.items() if k != "local"), F.lit(0))
    facts = F.struct(
        weighted_structure(values, c).alias("structural"),
        local.alias("local"),
        (local & (secondaries >= c.min_secondaries)).alias("certifiable"),
        F.when(geo_measurable, _long(geo_evidence)).otherwise(F.lit(0).cast("long")).alias("geo"),
        geo_measurable.alias("geo_measurable"),
        identical.alias("identical"),
    )
    return let(facts, lambda f: _judged(f, inliers, topology_class, diversity, coverage, mirrored, c))


def _judged(f: Column, inliers: Column, topology_class: Column, diversity: Column, coverage: Column, mirrored: Column, c: Calibration) -> Column:
    structural, certifiable = f["structural"], f["certifiable"]
    g_strong, g_weak = f["geo_measurable"] & (f["geo"] >= c.geo_strong), f["geo_measurable"] & (f["geo"] >= c.geo_weak)
    s_strong, s_moderate = certifiable & (structural >= c.strong), certifiable & (structural >= c.moderate)
    alone = s_strong & (structural >= c.solo)
    by_geometry = g_strong & (inliers >= c.geo_solo_inliers)
    none = F.array().cast("array<string>")

    def row(state: str, kind: Column | str, *basis: str) -> Column:
        return F.struct(F.lit(state).alias("state"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("class"), F.array(*map(F.lit, basis)).cast("array<string>").alias("basis"))

    said = F.when(g_strong, "geometry agrees but below the solo bar").when(s_strong, "structure agrees but below the solo bar").otherwise("partial agreement")
    some = F.concat(F.when(s_moderate, F.array(F.lit("structural"))).otherwise(none), F.when(g_weak, F.array(F.lit("geometric"))).otherwise(none))
    first = (
        F.when(f["identical"], row("Identical", "byte-identical fingerprint", "bytes"))
        .when(s_strong & g_strong, row("Copy", "certified — structure and geometry agree", "structural", "geometric"))
        .when(alone & (coverage >= c.coverage_floor), row("Copy", "structural only — no geometric corroboration", "structural"))
        .when(alone, row("Suspected", "capped — structural agreement without spatial support", "structural", "R4:support"))
        .when(by_geometry & topology_class.isin(2, 3, 4), row("Copy", F.when(mirrored, "geometric only — mirrored crop / collage class").otherwise("geometric only — crop / collage class"), "geometric"))
        .when(by_geometry, row("Suspected", "capped — geometry scattered, no coherent region", "geometric", "R3:scatter"))
        .when(s_strong | s_moderate | g_strong | g_weak, F.struct(F.lit("Suspected").alias("state"), said.alias("class"), some.alias("basis")))
        .when(structural >= c.weak, row("Related", "same family, not a copy"))
        .otherwise(row("Unrelated", "no agreement above chance"))
    )
    uncorroborated = f["local"] & (structural >= c.strong) & ~certifiable & ~f["identical"]

    def capped(v: Column) -> Column:
        basis = F.when(uncorroborated, F.array_append(v["basis"], F.lit("R1:corroboration"))).otherwise(v["basis"])
        repeated = (v["state"] == "Copy") & f["local"] & (diversity < c.repetition) & ~g_weak
        state = F.when(repeated, "Suspected").otherwise(v["state"])
        return F.struct(
            state.alias("state"),
            state_code(state).alias("code"),
            F.when(repeated, "capped — extreme repetition without geometric support").otherwise(v["class"]).alias("class"),
            F.when(repeated, F.array_append(basis, F.lit("R2:repetition"))).otherwise(basis).alias("basis"),
            F.when(f["identical"], F.lit(SCALE).cast("long")).otherwise(structural).alias("structural"),
            certifiable.alias("certifiable"),
        )

    return let(first, capped)


def state_code(state: Column) -> Column:
    out = F
    for name, code in STATES.items():
        out = out.when(state == name, code)
    return out.otherwise(-1)
