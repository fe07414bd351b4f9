"""Analyses of call families: columns computed from a call's text, with replaceable lexicons.

Each family is a function of (lower-cased text column, lexicons) that returns named columns.  ``analyze`` dispatches
call types to families inside one projection, so a table of mixed calls needs no split and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import lexicons as L
from palaver.functions import text as T

Columns = dict[str, Column]


def _lists(low: Column, groups: dict[str, list[str]]) -> Columns:
    return {name: T.hits(low, terms) for name, terms in groups.items()}


def _first_of_groups(low: Column, groups: dict[str, list[str]]) -> Column:
    """One entry per group with a hit: the group and its first term."""
    entries = [F.struct(F.lit(g).alias("signal"), T.first_hit(low, terms).alias("keyword")) for g, terms in groups.items()]
    return F.filter(F.array(*entries), lambda e: e["keyword"].isNotNull())


def sales(low: Column, buying=L.SALES, risk=L.SALES_RISK, competitors: list[str] = ()) -> Columns:
    names = [F.when(F.contains(low, F.lit(c.lower())), F.lit(c)) for c in competitors]
    return {"buying_signals": _first_of_groups(low, buying), "risk_signals": _first_of_groups(low, risk), "competitor_mentions": F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")}


def discovery(low: Column, commitments=L.COMMITMENTS, hypotheticals=L.HYPOTHETICALS) -> Columns:
    return {"commitment_signals": _first_of_groups(low, commitments), "hypothetical_questions": T.hits(low, hypotheticals)}


def pmf(low: Column, signals=L.PMF, features=L.FEATURES) -> Columns:
    score = {k: F.least(T.hit_count(low, terms) * 2.5, F.lit(10.0)) for k, terms in signals.items()}
    inc, fund = T.hit_count(low, features["incremental"]), T.hit_count(low, features["fundamental"])
    quality = F.when(inc + fund > 0, F.round(inc / (inc + fund) * 10, 1)).otherwise(5.0)
    dims = {"emotional_intensity": score["dependency"], "workflow_integration": score["workflow_depth"], "referral_evangelism": score["evangelism"], "switching_cost": score["switching_cost"], "feature_request_quality": quality, "willingness_to_pay": score["wtp"], "urgency": F.lit(0.0), "unprompted_praise": F.lit(0.0)}
    total = F.lit(0.0)
    for x in dims.values():
        total = total + x
    overall = F.round(total / len(dims), 1)
    anti = score["anti_pmf"]
    ellis = F.when((overall >= 7) & (anti <= 2), "very_disappointed").when(overall >= 4, "somewhat_disappointed").otherwise("not_disappointed")
    strongest = F.slice(F.array_compact(F.array(*[F.when(T.any_hit(low, terms), F.concat(F.lit(f"{k}: "), F.array_join(T.hits(low, terms), ", "))) for k, terms in signals.items() if k != "anti_pmf"])), 1, 5)
    return {"pmf_score": overall, **dims, "ellis_classification": ellis, "strongest_signals": strongest, "anti_pmf_flags": T.hits(low, signals["anti_pmf"])}


def interview(low: Column, star=L.STAR) -> Columns:
    counts = {k: T.hit_count(low, terms) for k, terms in star.items()}
    present = sum(((c > 0).cast("int") for c in counts.values()), F.lit(0))
    return {**{k: F.least(c, F.lit(3)) for k, c in counts.items()}, "components_present": present, "assessment": F.when(present == len(star), "complete").when(present >= 2, "partial").otherwise("incomplete"), "overall_star_score": F.round(present / len(star) * 10, 1)}


def support(low: Column, issues=L.ISSUES, words=L.SUPPORT) -> Columns:
    counts = [(k, T.hit_count(low, terms)) for k, terms in issues.items()]
    most = F.greatest(*[c for _, c in counts])
    kind = F.lit("other")
    for k, c in reversed(counts):
        kind = F.when((c == most) & (most > 0), k).otherwise(kind)
    bad, good = T.hit_count(low, words["frustration"]), T.hit_count(low, words["satisfaction"])
    return {
        "issue_type": kind,
        "severity": F.when(bad > 2, "high").otherwise("medium"),
        "start_emotion": F.when(bad > good, "frustrated").otherwise("neutral"),
        "end_emotion": F.when(bad > good, F.when(good == 0, "frustrated").otherwise("neutral")).when(good > 0, "satisfied").otherwise("neutral"),
        "frustration_signals": bad,
        "satisfaction_signals": good,
        "resolution_status": F.when(T.any_hit(low, words["resolution"]), "resolved").when(T.any_hit(low, words["escalation"]), "escalated").otherwise("unresolved"),
        "empathy_score": F.least(T.hit_count(low, words["empathy"]) * 2, F.lit(10)),
    }


def qbr(low: Column, words=L.QBR) -> Columns:
    good, bad = T.hit_count(low, words["positive"]), T.hit_count(low, words["negative"])
    churn = T.hit_count(low, words["churn"])
    return {"health_score": F.greatest(F.lit(0), F.least(F.lit(10), 5 + good - bad)), "positive_signals": good, "negative_signals": bad, "expansion_signals": T.hits(low, words["expansion"]), "churn_level": F.when(churn >= 3, "high").when(churn >= 1, "medium").otherwise("low"), "churn_indicators": T.hits(low, words["churn"])}


def relationship(low: Column, words=L.RELATIONSHIP) -> Columns:
    good, bad = T.hit_count(low, words["positive"]), T.hit_count(low, words["negative"])
    rate = F.try_divide(good, bad)
    return {
        "positive_count": good,
        "negative_count": bad,
        "ratio": F.concat(good.cast("string"), F.lit(":"), bad.cast("string")),
        "appreciation": F.when(bad == 0, F.when(good > 0, "healthy").otherwise("neutral")).when(rate >= 5, "healthy (5:1+)").when(rate >= 3, "approaching (3:1-5:1)").otherwise("concerning (<3:1)"),
    }


def pitch(low: Column, words=L.PITCH) -> Columns:
    return _lists(low, words)


def recruiting(low: Column, words=L.RECRUITING) -> Columns:
    return {"qualification_signals": T.hits(low, words["qualification_signals"]), "red_flags": T.hits(low, words["red_flags"]), "compensation_discussed": T.any_hit(low, words["compensation"])}


def management(low: Column, words=L.MANAGEMENT) -> Columns:
    return {**{k: T.hit_count(low, words[k]) for k in ("career", "status", "blockers")}, **{k: T.hits(low, words[k]) for k in ("burnout_indicators", "alignment_signals", "advice_given")}}


def operations(low: Column, words=L.OPERATIONS) -> Columns:
    return {**_lists(low, words), "blamelessness": F.when(T.any_hit(low, words["blame_signals"]), "concerning").otherwise("healthy")}


def time_discipline(first_start: Column, last_end: Column, limit: float = 900) -> Columns:
    """A standup's length against its limit."""
    took = last_end - first_start
    return {"duration_seconds": F.round(took, 1), "time_discipline": F.when(took <= limit, "good").otherwise("over_time")}


def customer(low: Column, words=L.CUSTOMER) -> Columns:
    return _lists(low, words)


def education(low: Column, words=L.EDUCATION) -> Columns:
    return {k: T.hit_count(low, terms) for k, terms in words.items()}


def therapy(low: Column, words=L.THERAPY) -> Columns:
    return _lists(low, words)


def nothing(low: Column) -> Columns:
    """Families whose analysis is that of a business meeting alone."""
    return {}


FAMILIES: dict[str, tuple[Callable[..., Columns], tuple[str, ...]]] = {
    "business": (nothing, ("business-meeting", "standup", "unknown")),
    "sales": (sales, ("sales-call", "sales-discovery", "sales-demo", "sales-negotiation")),
    "discovery": (discovery, ("discovery-call", "customer-discovery")),
    "pmf": (pmf, ("pmf-call",)),
    "interview": (interview, ("interview-behavioral", "interview-technical")),
    "support": (support, ("support-escalation", "support-call")),
    "qbr": (qbr, ("qbr",)),
    "relationship": (relationship, ("family", "partner", "personal")),
    "pitch": (pitch, ("investor-pitch", "investor-update")),
    "recruiting": (recruiting, ("recruiter-screen", "reference-check", "offer-negotiation")),
    "management": (management, ("one-on-one", "performance-review", "cofounder-alignment", "advisory-call", "board-meeting")),
    "operations": (operations, ("all-hands", "sprint-retro", "postmortem")),
    "customer": (customer, ("customer-onboarding", "churn-save", "renewal-expansion", "vendor-evaluation")),
    "education": (education, ("classroom", "lecture", "coaching-session")),
    "podcast": (nothing, ("podcast",)),
    "therapy": (therapy, ("therapy-session",)),
    "simple": (nothing, ("voice-memo", "medical-appointment", "legal-consultation", "fundraising-donor", "earnings-call", "due-diligence")),
}
#: Call type to family; other types are treated as simple ones.
DISPATCH = {kind: family for family, (_, kinds) in FAMILIES.items() for kind in kinds}


#: Sections that only one call type of a family has.
ONLY_FOR = {"operations": {"sprint-retro": ("went_well", "to_improve"), "postmortem": ("root_cause_signals", "blame_signals", "blamelessness")}, "education": {"coaching-session": ("goal", "reality", "options", "will")}}
#: Families that were there before any was registered.
BUILT_IN = frozenset(FAMILIES)


def register(name: str, build: Callable[..., Columns], kinds: list[str], only_for: dict[str, tuple[str, ...]] | None = None) -> None:
    """Add a family, or replace one: ``build`` makes named columns of the lower-cased text for calls of these types.

    Types that another family had go over to this one.  ``only_for``: sections that only one of its types has.
    """
    if not name or not kinds:
        raise ValueError("a family has a name and call types")
    for other, (made, had) in list(FAMILIES.items()):
        if other != name and set(had) & set(kinds):
            FAMILIES[other] = made, tuple(k for k in had if k not in kinds)
    FAMILIES[name] = build, tuple(kinds)
    ONLY_FOR.pop(name, None)
    if only_for:
        ONLY_FOR[name] = dict(only_for)
    _dispatch()


def unregister(name: str) -> None:
    """Take out a family that was registered; its types are treated as simple ones."""
    if name in BUILT_IN:
        raise ValueError(f"{name} is built in")
    FAMILIES.pop(name, None)
    ONLY_FOR.pop(name, None)
    _dispatch()


def _dispatch() -> None:
    DISPATCH.clear()
    DISPATCH.update({kind: family for family, (_, kinds) in FAMILIES.items() for kind in kinds})


def families_of(kinds: list[str]) -> list[str]:
    """The families of some call types, in order of registration."""
    wanted = {DISPATCH.get(k, "simple") for k in kinds}
    return [f for f in FAMILIES if f in wanted]


def present(calls: DataFrame, type_col: str = "call_type") -> list[str]:
    """The families of the call types that a table holds: there are few types, so few rows reach the driver."""
    return families_of([r[0] for r in calls.select(type_col).distinct().where(F.col(type_col).isin(*DISPATCH)).collect()])


def family_of(kind: Column) -> Column:
    """The family of a call type."""
    out = F.lit("simple")
    for family, (_, kinds) in FAMILIES.items():
        if kinds:
            out = F.when(kind.isin(*kinds), family).otherwise(out)
    return out


def analyze(calls: DataFrame, type_col: str = "call_type", competitors: list[str] = (), families: list[str] | None = None) -> DataFrame:
    """``calls`` with family and the family's sections as JSON (null sections left out); ``competitors`` are looked for in sales calls.

    Columns are built for ``families`` only (default: all that are registered): where a table holds few call types, give
    ``present(calls)`` and the plan has no terms of the others.  Calls of families that are left out have no sections.
    """
    unknown = set(families or ()) - set(FAMILIES)
    if unknown:
        raise ValueError(f"no such family: {', '.join(sorted(unknown))}")
    low = T.lower("text")
    sections = None
    for family, (build, kinds) in FAMILIES.items():
        if not kinds or (families is not None and family not in families):
            continue
        columns = build(low, competitors=competitors) if build is sales else build(low)
        if not columns:
            continue
        for kind, names in ONLY_FOR.get(family, {}).items():
            for n in names:
                columns[n] = F.when(F.col(type_col) == kind, columns[n])
        made = F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))
        hit = F.col(type_col).isin(*kinds)
        sections = F.when(hit, made) if sections is None else sections.when(hit, made)
    return calls.withColumn("family", family_of(F.col(type_col))).withColumn("sections", F.lit("{}") if sections is None else F.coalesce(sections, F.lit("{}")))
