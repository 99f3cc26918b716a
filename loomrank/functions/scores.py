"""Score functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from . import vocab as V


def num(v: float) -> Column:
    return F.lit(float(v))


def squashed(logit: Column, tau: float = V.SQUASH) -> Column:
    return 1.0 / (1.0 + F.exp(-logit / tau))


def valid_years(y: Column) -> Column:
    """Over ten years counts as five, under none as none."""
    return F.when(y > 10, 5.0).when(y < 0, 0.0).otherwise(y)


def experience(jd: Column, own: Column) -> Column:
    """Without a requirement half a point a year from a half; else the share of the years asked for, at most 1; 3 digits."""
    ratio = own / F.nullif(jd, num(0))
    return F.when(jd <= 0, F.least(0.5 + own * 0.5, num(1))).otherwise(F.round(F.least(F.when(ratio < 1, ratio).otherwise(1.0 + F.least(ratio - 1.0, num(0.2)) * 0.5), num(1)), 3))


def experience_capped(jd: Column, own: Column) -> Column:
    """As ``experience`` with the bonus of over-qualification, at most 1.2."""
    ratio = own / F.nullif(jd, num(0))
    return F.when(jd <= 0, F.least(0.5 + own * 0.5, num(1))).otherwise(F.round(F.least(F.when(ratio < 1, ratio).otherwise(1.0 + F.least(ratio - 1.0, num(0.2)) * 0.5), num(1.2)), 3))


def experience_plain(jd: Column, own: Column) -> Column:
    return F.when(F.coalesce(jd, num(0)) <= 0, 1.0).when(own >= jd, 1.0).otherwise(own / F.nullif(jd, num(0)))


def education(jd: Column, own: Column) -> Column:
    """1 without a requirement, with a common degree group, or with one named inside the other; else 0."""
    a, b = F.transform(jd, X.normal_degree), F.transform(own, X.normal_degree)
    inside = F.exists(a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)))
    return F.when(F.size(jd) == 0, 1.0).when(F.arrays_overlap(a, b) | inside, 1.0).otherwise(0.0)


def overlap(left: Column, right: Column) -> Column:
    """Share of the left set found in the right one, case aside; 1 for an empty left."""
    a, b = F.array_distinct(F.transform(left, F.lower)), F.transform(right, F.lower)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def exact_share(left: Column, right: Column) -> Column:
    """Share of the left set found in the right one; 0 for an empty left."""
    n = F.size(F.array_distinct(left))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / n)


def education_parts(jd_degrees: Column, own_degrees: Column, jd_text: Column, own_text: Column) -> Column:
    """0.4 degree share + 0.3 field share + 0.3 grade (a half if unknown), 3 digits."""

    def fields(t: Column) -> Column:
        return F.filter(X.strings(V.SCORED_FIELDS), lambda f: F.contains(t, f))

    jd_fields, own_fields = fields(jd_text), fields(own_text)
    degree = F.when(F.size(jd_degrees) == 0, 1.0).otherwise(exact_share(jd_degrees, own_degrees))
    field = F.when(F.size(jd_fields) == 0, 1.0).otherwise(F.size(F.array_intersect(jd_fields, own_fields)) / F.size(jd_fields))
    return F.round(0.4 * degree + 0.3 * field + 0.3 * F.coalesce(X.grade(own_text), num(0.5)), 3)


def recency(c: Column, this_year: int) -> Column:
    age = this_year - F.array_max(X.years_named(c))
    return F.when(age.isNull(), 0.0).when(age <= 1, 1.0).when(age <= 2, 0.8).when(age <= 4, 0.5).otherwise(0.2)


def context_boost(base: Column, jd_domains: Column, own_domains: Column, c: Column, this_year: int) -> Column:
    return F.round(F.least(base + 0.1 * exact_share(jd_domains, own_domains) + 0.1 * recency(c, this_year), num(1)), 3)


def evidence_share(matched: Column, text: Column) -> Column:
    """Share of the matched skills whose normal form stands in the text."""
    found = X.let(F.lower(text), lambda low: F.size(F.filter(matched, lambda s: F.contains(low, X.normal_skill(s)))))
    return F.when(F.size(matched) == 0, 0.0).otherwise(found / F.size(matched))


def evidence_sections(matched: Column, experience_text: Column, project_text: Column) -> Column:
    both = F.lower(F.concat_ws(" ", F.coalesce(experience_text, F.lit("")), F.coalesce(project_text, F.lit(""))))
    found = X.let(both, lambda low: F.when(F.trim(low) == "", 0).otherwise(F.size(F.filter(matched, lambda s: F.contains(low, F.lower(s))))))
    return F.when(F.size(matched) == 0, 0.0).otherwise(found / F.size(matched))


def normal_weights(w: dict[str, Column], default: dict[str, float] | None = None) -> dict[str, Column]:
    """Weights divided by their sum; a sum that isn't positive gives the default set (without one, they stay)."""
    total = sum(w.values(), num(0))
    base = sum((default or {}).values()) or 1.0
    return {k: F.when(total > 0, v / total).otherwise(num(default[k] / base) if default else v) for k, v in w.items()}


def adaptive(jd_text: Column, jd_years: Column, has_education: Column, base: dict[str, float] = V.WEIGHTS) -> dict[str, Column]:
    """Base weights moved by what the query document asks for: seniority, no years, no degree."""
    senior = F.exists(X.strings(V.SENIOR_CUES), lambda s: F.contains(F.lower(jd_text), s))
    w = {k: num(v) for k, v in base.items()}
    w["experience"] += F.when(senior, 0.10).otherwise(0.0)
    w["semantic"] -= F.when(senior, 0.10).otherwise(0.0)
    half = F.when(jd_years == 0, w["experience"] * 0.5).otherwise(0.0)
    w["required_skills"], w["projects"], w["experience"] = w["required_skills"] + half, w["projects"] + half, F.when(jd_years == 0, 0.0).otherwise(w["experience"])
    half = F.when(has_education, 0.0).otherwise(w["education"] * 0.5)
    w["reranker"], w["semantic"], w["education"] = w["reranker"] + half, w["semantic"] + half, F.when(has_education, w["education"]).otherwise(0.0)
    return normal_weights(w, base)


def adaptive_eight(has_preferred: Column, has_years: Column, has_education: Column) -> dict[str, Column]:
    """The scheme of eight signals: what a query document doesn't ask for goes to required skills or to semantics."""
    w = {k: num(v) for k, v in V.WEIGHTS_EIGHT.items()}
    for ask, key, to in ((has_preferred, "preferred_skills", "required_skills"), (has_years, "experience", "semantic"), (has_education, "education", "semantic")):
        w[to] = w[to] + F.when(ask, 0.0).otherwise(w[key])
        w[key] = F.when(ask, w[key]).otherwise(0.0)
    return normal_weights(w)


def user_weights(w: dict[str, Column]) -> dict[str, Column]:
    """Percentages from a user, floored at 0; all zero gives the defaults."""
    return normal_weights({k: F.greatest(v, num(0)) / 100.0 for k, v in w.items()}, V.WEIGHTS)


def combined(weights: dict[str, Column], signals: dict[str, Column]) -> Column:
    return F.round(sum((weights[k] * signals[k] for k in weights), num(0)), 4)


def verdict(best: Column) -> Column:
    return F.when(best > V.DEMONSTRATED, "demonstrated").when(best > V.CLAIMED, "claimed_only").otherwise("absent")


def verdict_value(v: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in V.VERDICT_VALUES.items() for x in kv]), v), num(0))


def verdict_label(v: Column) -> Column:
    return F.coalesce(F.element_at(X.mapping({"demonstrated": "Demonstrated", "claimed_only": "Claimed only", "absent": "Absent"}), v), F.lit("Unknown"))


def score_band(s: Column) -> Column:
    return F.when(s >= 0.75, "high").when(s >= 0.5, "medium").otherwise("low")


def slice_clamped(c: Column, start: Column, end: Column) -> Column:
    """The text between two offsets clamped to it; null where nothing is left."""
    a, b = F.greatest(start, F.lit(0)), F.least(end, F.length(c))
    return F.when(a < b, F.substring(c, a + 1, b - a))
