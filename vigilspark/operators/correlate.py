"""Alert correlation (C01-C11) and the custom-rule hook.

A rule says which alert rules trigger it, which alert rules are their partners, what the
entity is and how long the window W is. Event time, then event id, defines arrival order.
An alert *triggers* when at least one partner alert of the same entity arrived before it
(or with the same event) within W. Triggers of one (type, entity) closer than W form an
episode, which is one correlation.

Nothing here joins alerts with alerts. Time is cut into bins of length W per entity:

* counts of partners in a band are running counts within a bin. An alert enters its own bin and
  leaves the next one, so what a bin opens with is what leaves it, and one task sees one
  entity for one bin. Only the numbering by arrival needs a total of the bins before;
* two triggers in one bin are always in the same episode, so episodes are found on one row
  per (type, entity, bin);
* whether an alert belongs to an episode depends only on the last trigger of its bin and
  the first of the next one, i.e. on one small row per (type, entity, bin).

Members of a correlation are rows of a second table, not an array: an episode of a busy
entity can hold any number of alerts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import present, short_id
from ..session import stage
from .detect import BUILTIN_RULES, DetectionRule

#: Kinds of alerts that are counted side by side.
KINDS_AT_ONCE = 32
KEY = ["correlation_type", "entity_key"]


def _user() -> Column:
    return F.when(present(F.col("user")), F.concat(F.lit("user:"), "user"))


def _host() -> Column:
    return F.when(present(F.col("host")), F.concat(F.lit("host:"), "host"))


def _source_ip() -> Column:
    return F.when(present(F.col("source_ip")), F.concat(F.lit("source_ip:"), "source_ip"))


def _dataset() -> Column:
    dataset_id = F.col("evidence").getItem("dataset_id")
    return F.when(present(dataset_id), F.concat(F.lit("dataset:"), dataset_id))


def _user_and_dataset() -> Column:
    return F.coalesce(F.concat(_user(), F.lit(":"), _dataset()), _user(), _dataset(), _host())


def _fmt(template: str, **values: Column) -> Column:
    """Fill ``{name}`` places of a template with columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        parts += [F.lit(head), F.coalesce(values[name].cast("string"), F.lit("None"))]
    return F.concat(*parts, F.lit(rest))


@dataclass(frozen=True)
class CorrelationRule:
    """Declarative correlation rule.

    ``pairs`` maps a trigger rule id to its partner rule ids. ``severity`` gets the number
    of alerts in the match; ``None`` takes the highest severity in the match. ``mitre`` of
    ``None`` takes the techniques of all alerts in the match, plus ``extra_mitre``.
    """

    rule_id: str
    correlation_type: str
    window_seconds: int
    entity: Callable[[], Column]
    pairs: dict[str, tuple[str, ...]]
    title: str
    description: str
    severity: Callable[[Column], Column] | None
    mitre: tuple[str, ...] | None = None
    extra_mitre: tuple[str, ...] = ()
    evidence: tuple[str, ...] = field(default=())

    @property
    def members(self) -> list[str]:
        return sorted(set(self.pairs) | {p for ps in self.pairs.values() for p in ps})


def _const(value: int) -> Callable[[Column], Column]:
    return lambda n: F.lit(value)


def _growing(base: int, step: int) -> Callable[[Column], Column]:
    return lambda n: F.least(F.lit(15), F.lit(base) + (n - 2) * step)


def same_entity_pairs(rule_ids: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Every two different rules, except the pairs that have a rule of their own."""
    taken = [
        {"builtin-002", "builtin-004"}, {"builtin-005", "builtin-002"}, {"builtin-005", "builtin-003"},
    ]
    return {a: tuple(b for b in rule_ids if b != a and {a, b} not in taken) for a in rule_ids}


def endpoint_rules(detection: Sequence[DetectionRule] = BUILTIN_RULES) -> list[CorrelationRule]:
    """C01-C04, the set that runs on endpoint telemetry."""
    ids = [r.rule_id for r in detection]
    return [
        CorrelationRule(
            "corr-rule-001", "auth_attack_sequence", 900,
            lambda: F.coalesce(_user(), _source_ip(), _host()),
            {"builtin-003": ("builtin-003",)},
            "Authentication Attack Sequence against {entity}",
            "Multiple authentication failure alerts ({n}) observed for {entity} within 15 minutes.",
            _growing(8, 2), ("T1110",),
            evidence=("entity_key", "alert_count", "rule_type", "time_window_seconds"),
        ),
        CorrelationRule(
            "corr-rule-002", "process_network_sequence", 1800, _host,
            {"builtin-002": ("builtin-004",), "builtin-004": ("builtin-002",)},
            "Suspicious Process and Network Connection on {entity}",
            "Suspicious process execution followed by network connection observed on {entity} within 30 minutes.",
            _const(12), ("T1059", "T1071"),
            evidence=("entity_key", "host", "rules_correlated", "time_window_seconds"),
        ),
        CorrelationRule(
            "corr-rule-003", "privilege_escalation_sequence", 1800,
            lambda: F.coalesce(_user(), _host()),
            {"builtin-005": ("builtin-002", "builtin-003"), "builtin-002": ("builtin-005",),
             "builtin-003": ("builtin-005",)},
            "Privilege Escalation Sequence on {entity}",
            "Privilege escalation activity correlated with suspicious process or authentication event on {entity} "
            "within 30 minutes.",
            _const(14), None, ("T1548",),
            evidence=("entity_key", "rules_correlated", "time_window_seconds"),
        ),
        CorrelationRule(
            "corr-rule-004", "same_entity", 1800, lambda: F.coalesce(_host(), _user()),
            same_entity_pairs(ids),
            "Multiple Security Alerts on {entity}",
            "Multiple distinct security alerts ({n}) observed on {entity} within 30 minutes.",
            None, None,
            evidence=("entity_key", "distinct_rules", "alert_count", "time_window_seconds"),
        ),
    ]


def dataset_rules() -> list[CorrelationRule]:
    """C05-C07."""
    return [
        CorrelationRule(
            "corr-dset-001", "data_exfiltration_sequence", 1800, _user_and_dataset,
            {"dataset-003": ("dataset-001", "dataset-002")},
            "Data Exfiltration Sequence: {entity}",
            "Dataset access sequence detected for {entity}: {partners} access alert(s) followed by export of "
            "'{dataset_name}' within 30 minutes.",
            _growing(12, 1), ("T1530", "T1567"),
            evidence=("entity_key", "alert_count", "dataset_name", "access_alert_count", "rule_type",
                      "time_window_seconds"),
        ),
        CorrelationRule(
            "corr-dset-002", "access_anomaly_sequence", 900, _user_and_dataset,
            {"dataset-001": ("dataset-004",), "dataset-002": ("dataset-004",)},
            "Access Anomaly Sequence: {entity}",
            "Unusual actor {entity} performed sensitive or bulk dataset access within 15 minutes of anomalous actor "
            "detection.",
            _const(11), ("T1530",),
            evidence=("entity_key", "alert_count", "unusual_actor_alerts", "rule_type", "time_window_seconds"),
        ),
        CorrelationRule(
            "corr-dset-003", "mass_modification_sequence", 3600, _dataset,
            {"dataset-006": ("dataset-005",)},
            "Mass Modification Sequence: {dataset_name}",
            "Dataset '{dataset_name}' experienced mass record modification followed by schema change within 60 "
            "minutes.",
            _const(12), ("T1485",),
            evidence=("entity_key", "dataset_id", "dataset_name", "alert_count", "rule_type", "time_window_seconds"),
        ),
    ]


def all_rules(detection: Sequence[DetectionRule] = BUILTIN_RULES) -> list[CorrelationRule]:
    """C01-C07, the set that runs on dataset activity."""
    return endpoint_rules(detection) + dataset_rules()


# --- participations ---------------------------------------------------------------------


def _floor_div(value: Column, width: Column) -> Column:
    return ((value - F.pmod(value, width)) / width).cast("bigint")


def _takes(asked_by: Column, rule_order: Column) -> Column:
    """Whether a trigger of the rule at this position takes the alert as partner."""
    return F.array_contains(asked_by, rule_order)


def participations(
    alerts: DataFrame, rules: Sequence[CorrelationRule], detection: Sequence[DetectionRule] = BUILTIN_RULES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per alert and correlation type it can take part in, as trigger or partner.

    Rules are told apart by their position in ``detection``, never by severity. ``asks`` holds the
    rules whose alerts this one would take as partner if it triggers; ``asked_by`` those whose
    trigger would take this one. ``level`` is the severity where the highest one of the match is
    wanted, else null.
    """
    order = {r.rule_id: i for i, r in enumerate(detection)}

    def by_rule(values: dict[str, list[int]]) -> Column:
        """One branch for each different list, however many rules share it."""
        out = F.array().cast("array<int>")
        lists: dict[tuple[int, ...], list[str]] = {}
        for rule_id, value in values.items():
            lists.setdefault(tuple(sorted(value)), []).append(rule_id)
        for value, ids in lists.items():
            if value:
                out = F.when(F.col("rule_id").isin(*ids), F.array(*[F.lit(v) for v in value])).otherwise(out)
        return out

    def option(r: CorrelationRule) -> Column:
        asks = {t: [order[p] for p in ps if p in order] for t, ps in r.pairs.items()}
        asked = {m: [order[t] for t, ps in r.pairs.items() if m in ps and t in order] for m in r.members}
        return F.when(
            F.col("rule_id").isin(*r.members) & r.entity().isNotNull(),
            F.struct(
                F.lit(r.correlation_type).alias("correlation_type"),
                r.entity().alias("entity_key"),
                F.lit(r.window_seconds * 1_000_000).cast("bigint").alias("window_us"),
                by_rule(asks).alias("asks"),
                by_rule(asked).alias("asked_by"),
                (F.col("severity") if r.severity is None else F.lit(None)).cast("int").alias("level"),
            ),
        )

    numbers = F.create_map(*[F.lit(x) for pair in order.items() for x in pair]) if order else F.create_map().cast("map<string,int>")
    return (
        alerts.withColumn("p", F.explode(F.array_compact(F.array(*[option(r) for r in rules]))))
        .select(
            "p.*", "alert_id", "event_id", "timestamp", "rule_id", "rule_order", "severity",
            F.try_element_at(numbers, F.col("rule_id")).alias("rule_no"),
            F.col("evidence").getItem("dataset_id").alias("dataset_id"),
            F.col("evidence").getItem("dataset_name").alias("dataset_name"),
            F.unix_micros("timestamp").alias("ts_us"), *keep,
        )
        .withColumn("bin", _floor_div(F.col("ts_us"), F.col("window_us")))
    )


def score_participations(parts: DataFrame, columns: int = KINDS_AT_ONCE) -> DataFrame:
    """Adds to every participation what arrived before it within the window.

    New columns: ``partners`` (number of partner alerts), ``matched`` (rule and level of the
    alerts in the match, once each, the alert's own included) and ``seq``, a number that orders the
    alerts of one (type, entity) by arrival; alerts of one event have the same. A kind is a rule, at a
    level where levels matter; kinds are numbered within their entity, so any number of rules and
    severities does. Up to ``columns`` kinds (62 at most) are counted side by side, more in further rows.

    An alert is shuffled twice: as itself, and without its columns one window later, where it leaves
    the band of the alerts there. That is always in the next bin, and every alert that leaves a bin
    was there when it began.
    """
    told = F.collect_set(F.struct(F.col("rule_no").alias("no"), "level", "asks"))
    kinds = stage(
        parts.groupBy(*KEY).agg(told.alias("told")).withColumn(
            "kinds", F.array_sort(F.array_distinct(F.transform("told", lambda t: F.struct(t["no"].alias("no"), t["level"].alias("level")))))
        ),
        "kinds",
    )
    most = kinds.agg(F.max(F.size("kinds"))).first()[0] or 1
    names = [f"c{i}" for i in range(min(columns, most, 62))]
    width = len(names)
    of = kinds.select(*[F.col(k).alias(f"of_{k}") for k in KEY], "kinds")
    sets = F.sequence(F.lit(0), F.floor((F.size("kinds") - 1) / width).cast("int"))

    def wanted(a_set: Column) -> Column:
        """The kinds of a set that the alert asks for, one bit each."""
        bits = F.transform(
            F.slice("kinds", a_set * width + 1, width),
            lambda k, i: F.when(F.array_contains("t.asks", k["no"]), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(0),
        )
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    # found once per entity and kind, not once per alert
    mine = F.struct(F.col("t.no").alias("no"), F.col("t.level").alias("level"))
    own = kinds.withColumn("t", F.explode("told")).select(
        *[F.col(k).alias(f"of_{k}") for k in KEY], F.col("t.no").alias("of_no"), F.col("t.level").alias("of_level"), F.col("t.asks").alias("of_asks"),
        (F.array_position("kinds", mine) - 1).cast("int").alias("kind"), F.transform(sets, wanted).alias("wants"),
    )
    numbered = parts.join(own, [
        *[F.col(k) == F.col(f"of_{k}") for k in KEY], F.col("rule_no").eqNullSafe(F.col("of_no")), F.col("level").eqNullSafe(F.col("of_level")),
        F.col("asks") == F.col("of_asks"),
    ])

    # turn 0: the alert itself, in every set of kinds; turn 1: it leaves, in the set of its own kind
    own_set = F.floor(F.col("kind") / width).cast("int")
    here = F.transform("wants", lambda w, i: F.struct(F.lit(0).alias("turn"), F.col("ts_us").alias("at_us"), i.alias("set"), w.alias("wants")))
    gone = F.array(F.struct(
        F.lit(1).alias("turn"), (F.col("ts_us") + F.col("window_us")).alias("at_us"), own_set.alias("set"), F.lit(0).cast("bigint").alias("wants"),
    ))
    # time and bin follow from the time in microseconds, so they aren't shuffled
    carried = [c for c in parts.columns if c not in (*KEY, "event_id", "ts_us", "timestamp", "bin")]
    itself = F.col("e.turn") == 0
    ends = numbered.withColumn("e", F.explode(F.when(F.size("asked_by") > 0, F.concat(here, gone)).otherwise(here))).select(
        *KEY, "e.set", _floor_div(F.col("e.at_us"), F.col("window_us")).alias("bin"),
        "e.at_us", "e.turn", F.when(itself, F.col("event_id")).alias("event_id"), "e.wants",
        (F.col("kind") - F.col("e.set") * width).alias("column"), F.when(itself, F.struct(*carried)).alias("alert"),
    )
    comes, leaves = F.col("turn") == 0, F.col("turn") == 1
    in_bin = Window.partitionBy(*KEY, "set", "bin").orderBy("at_us", "turn", "event_id")
    whole_bin = in_bin.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    together = Window.partitionBy(*KEY, "set", "bin", "at_us", "turn", "event_id")
    sign = F.when(comes, 1).otherwise(-1)
    running = ends.withColumns({
        **{n: F.sum(F.when(F.col("column") == i, sign).otherwise(0).cast("bigint")).over(in_bin) for i, n in enumerate(names)},
        **{f"o{n}": F.sum((leaves & (F.col("column") == i)).cast("bigint")).over(whole_bin) for i, n in enumerate(names)},
        "place": F.sum(comes.cast("bigint")).over(in_bin),
    }).withColumn("copies", F.collect_list("alert.alert_id").over(together))
    before = Window.partitionBy(*KEY, "set").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ends.where(comes).groupBy(*KEY, "set", "bin").agg(F.count("*").alias("places"))
        .select(*KEY, "set", "bin", F.coalesce(F.sum("places").over(before), F.lit(0)).alias("earlier"))
        .join(of, [F.col(k) == F.col(f"of_{k}") for k in KEY]).drop(*[f"of_{k}" for k in KEY])
    )
    # an alert that comes repeatedly counts what each of its rows sees
    times = F.when(F.size("copies") < 2, 1).otherwise(F.size(F.filter("copies", lambda a: a == F.col("alert.alert_id"))))
    counted = (
        running.where("turn = 0 and alert.alert_id is not null").withColumn("times", times)
        .join(offsets, [*KEY, "set", "bin"])
    )
    bit = [F.lit(1 << i).cast("bigint") for i in range(width)]
    found = [F.col("times") * (F.col(n) + F.col(f"o{n}")) - (F.col("column") == i).cast("bigint") for i, n in enumerate(names)]
    asked = [F.col("wants").bitwiseAND(b) != 0 for b in bit]
    partners = reduce(add, [F.when(a, n).otherwise(0) for a, n in zip(asked, found)])
    present_bits = reduce(add, [F.when((F.col("column") == i) | (a & (n > 0)), b).otherwise(0) for i, (a, n, b) in enumerate(zip(asked, found, bit))])
    # the filter also keeps these long sums out of one whole-stage method, which would be too long to be compiled
    in_set = F.filter("kinds", lambda k, i: F.floor(i / width) == F.col("set"))
    counted = counted.select(
        *KEY, "set", "event_id", F.col("at_us").alias("ts_us"), "alert.*", "bin", in_set.alias("kinds"),
        (F.col("earlier") + F.col("place")).alias("seq"),
        partners.alias("partners"), present_bits.alias("bits"),
    ).withColumn("timestamp", F.timestamp_micros("ts_us"))
    # named twice, the bits are computed before; named in the lambda alone, Spark computes them anew for every kind
    matched = F.when(F.col("bits") == 0, F.slice("kinds", 1, 0)).otherwise(F.filter(
        "kinds",
        lambda k, i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1).cast("bigint")) != 0,
    ))
    counted = counted.withColumn("matched", matched).drop("kinds", "bits")
    if most > width:
        same = [*KEY, "alert_id", "ts_us"]
        sums = counted.groupBy(*same).agg(F.array_sort(F.collect_set(F.struct("set", "partners", "matched"))).alias("sets"))
        counted = counted.where("set = 0").drop("partners", "matched").join(sums, same).withColumns({
            "partners": F.aggregate("sets.partners", F.lit(0).cast("bigint"), lambda acc, x: acc + x),
            "matched": F.flatten("sets.matched"),
        })
    return counted.select(*parts.columns, "seq", "partners", "matched")


# --- matches (C08) ----------------------------------------------------------------------


def _per_rule(rules: Sequence[CorrelationRule], value: Callable[[CorrelationRule], Column]) -> Column:
    out = None
    for r in rules:
        hit = F.col("correlation_type") == r.correlation_type
        out = F.when(hit, value(r)) if out is None else out.when(hit, value(r))
    return out


def correlation_matches(
    scored: DataFrame, rules: Sequence[CorrelationRule], detection: Sequence[DetectionRule] = BUILTIN_RULES, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per trigger: the match it makes with the alerts before it, and the columns ``keep``."""
    n = (F.col("partners") + 1).alias("alert_count")
    texts = {
        "entity": F.col("entity_key"), "n": F.col("partners") + 1, "partners": F.col("partners"),
        "dataset_name": F.col("dataset_name"),
    }
    rule_ids = F.array(*[F.lit(r.rule_id) for r in detection])
    techniques = F.array(*[F.array(*[F.lit(m) for m in r.mitre]).cast("array<string>") for r in detection])
    numbers = F.transform(F.filter("matched", lambda k: k["no"].isNotNull()), lambda k: k["no"])
    matched_rules = F.array_sort(F.array_distinct(F.transform(numbers, lambda no: F.get(rule_ids, no))))

    def mitre(r: CorrelationRule) -> Column:
        if r.mitre is not None:
            return F.array(*[F.lit(m) for m in r.mitre])
        every = F.flatten(F.transform(numbers, lambda no: F.get(techniques, no)))
        return F.array_sort(F.array_union(every, F.array(*[F.lit(m) for m in r.extra_mitre]).cast("array<string>")))

    def severity(r: CorrelationRule) -> Column:
        if r.severity is None:
            value = F.greatest(F.lit(0), F.col("severity"), F.array_max(F.transform("matched", lambda k: k["level"])))
        else:
            value = r.severity(F.col("partners") + 1)
        return value.cast("int")

    fields = {
        "entity_key": lambda r: F.col("entity_key"),
        "alert_count": lambda r: F.col("partners") + 1,
        "access_alert_count": lambda r: F.col("partners"),
        "unusual_actor_alerts": lambda r: F.col("partners"),
        "rule_type": lambda r: F.lit(r.correlation_type),
        "time_window_seconds": lambda r: F.lit(r.window_seconds),
        "host": lambda r: F.substring_index("entity_key", "host:", -1),
        "rules_correlated": lambda r: F.to_json(
            F.array(*[F.lit(m) for m in r.members]) if r.mitre is not None else matched_rules
        ),
        "distinct_rules": lambda r: F.to_json(matched_rules),
        "dataset_id": lambda r: F.col("dataset_id"),
        "dataset_name": lambda r: F.col("dataset_name"),
    }

    def evidence(r: CorrelationRule) -> Column:
        pairs: list[Column] = []
        for key in r.evidence:
            pairs += [F.lit(key), fields[key](r).cast("string")]
        return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")

    return scored.where("partners > 0").select(
        _per_rule(rules, lambda r: F.lit(r.rule_id)).alias("correlation_rule_id"),
        *KEY, "alert_id", "event_id", "timestamp", "rule_id", "rule_order", "ts_us", "window_us", "bin",
        n,
        _per_rule(rules, severity).alias("severity"),
        _per_rule(rules, lambda r: _fmt(r.title, **texts)).alias("title"),
        _per_rule(rules, lambda r: _fmt(r.description, **texts)).alias("description"),
        _per_rule(rules, mitre).alias("mitre_techniques"),
        _per_rule(rules, evidence).alias("evidence"),
        matched_rules.alias("matched_rules"), *keep,
    )


# --- episodes (C09-C11) -----------------------------------------------------------------


class Correlations(NamedTuple):
    """``correlations``: one row per episode. ``members``: one row per alert of an episode.
    ``outcomes``: one row per (event, correlation) with what the event did to it.
    ``triggers``: the triggering alerts of each."""

    correlations: DataFrame
    members: DataFrame
    outcomes: DataFrame
    triggers: DataFrame | None = None


def _around(points: DataFrame) -> DataFrame:
    """A point concerns the alerts of its own bin and of the bin before."""
    return points.withColumn("at_bin", F.col("bin")).withColumn(
        "bin", F.explode(F.array(F.col("bin"), F.col("bin") - 1))
    )


def _last_growing(
    points: DataFrame, parts: DataFrame, triggers: DataFrame, use_prior: bool
) -> DataFrame:
    """Which of several triggers of one event was the last to add an alert to the episode.

    ``points`` has one row per episode: the event and its triggers in rule order. Only the
    alerts in the band before that one event are looked at.
    """
    band = _around(
        points.where("size(siblings) > 1").select(
            *KEY, "episode", "bin", "window_us", F.col("ts_us").alias("p_ts_us"),
            F.col("event_id").alias("p_event_id"), F.col("seq").alias("p_seq"), "siblings",
        )
    )
    in_band = (F.col("ts_us") >= F.col("p_ts_us") - F.col("window_us")) & (F.col("seq") <= F.col("p_seq"))
    narrow = parts.drop("window_us")
    inside = narrow.join(band, [*KEY, "bin"]).where(in_band)
    if use_prior:
        earlier = triggers.select(*KEY, "bin", "rule_order", "ts_us", "seq")
        prior = (
            earlier.join(band.drop("siblings"), [*KEY, "bin"])
            .where(in_band & (F.col("seq") < F.col("p_seq")))
            .groupBy(*KEY, "episode", "rule_order").agg(F.max("seq").alias("key"))
            .groupBy(*KEY, "episode").agg(F.collect_list(F.struct("rule_order", "key")).alias("prior"))
        )
        inside = inside.join(prior, [*KEY, "episode"], "left")
        known = F.coalesce(
            F.exists("prior", lambda p: _takes(F.col("asked_by"), p["rule_order"]) & (p["key"] >= F.col("seq"))),
            F.lit(False),
        ) | (F.col("is_trigger") & (F.col("event_id") != F.col("p_event_id")))
        inside = inside.where(~known)
    taken = F.filter(
        F.transform(
            "siblings",
            lambda s: F.when(
                (s["alert_id"] == F.col("alert_id"))
                | _takes(F.col("asked_by"), s["rule_order"]),
                s["rule_order"],
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return (
        inside.withColumn("first_taken", F.array_min(taken))
        .where("first_taken is not null")
        .groupBy(*KEY, "episode").agg(F.max("first_taken").alias("growing_order"))
    )


def correlate(
    alerts: DataFrame,
    rules: Sequence[CorrelationRule] | None = None,
    detection: Sequence[DetectionRule] = BUILTIN_RULES,
    compat: bool = True,
) -> Correlations:
    """Correlations of a whole alert table.

    ``compat``: techniques of a correlation stay those of its first match. Without it they
    are the union over all members.
    """
    rules = all_rules(detection) if rules is None else list(rules)
    parts = stage(participations(alerts, rules, detection), "participations")
    scored = score_participations(parts).withColumn("is_trigger", F.col("partners") > 0)
    scored = stage(scored, "scored")
    return episodes(scored, rules, detection, compat)


def episodes(
    scored: DataFrame,
    rules: Sequence[CorrelationRule],
    detection: Sequence[DetectionRule] = BUILTIN_RULES,
    compat: bool = True,
) -> Correlations:
    triggers = scored.where("is_trigger")

    # 1. episodes on one row per (type, entity, bin). Over all alerts only numbers are aggregated, which needs no sorting
    ours = {c: F.when(F.col("is_trigger"), F.col(c)) for c in ("ts_us", "seq")}
    per_rule = stage(
        correlation_matches(scored, rules, detection, keep=["seq", "is_trigger"]).groupBy(*KEY, "bin", "rule_order").agg(
            F.max("window_us").alias("window_us"), F.max("severity").alias("severity"), F.count("*").alias("n"),
            F.min("ts_us").alias("first_at"), F.min("seq").alias("first_seq"), F.max("ts_us").alias("last_at"), F.max("seq").alias("last_seq"),
            F.min(ours["ts_us"]).alias("lo"), F.max(ours["ts_us"]).alias("hi"), F.max(ours["seq"]).alias("newest"),
        ),
        "per-rule",
    )
    by_time = Window.partitionBy(*KEY).orderBy("bin")
    bins = stage(
        per_rule.groupBy(*KEY, "bin")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("window_us").alias("window_us")).where("lo is not null")
        .withColumn("starts", (F.coalesce(F.col("lo") - F.lag("hi").over(by_time) > F.col("window_us"), F.lit(True))).cast("int"))
        .withColumn("episode", F.sum("starts").over(by_time))
        .select(*KEY, "bin", "episode"),
        "bins",
    )
    placed = per_rule.join(bins, [*KEY, "bin"])

    # 2. first and last trigger event of every episode, with the event's triggers in order
    edge = stage(
        placed.groupBy(*KEY, "episode").agg(
            F.max("window_us").alias("window_us"), F.min("first_at").alias("first_at"), F.min("first_seq").alias("first_seq"),
            F.max("last_at").alias("last_at"), F.max("last_seq").alias("last_seq"),
            F.max("severity").alias("severity"), F.sum("n").alias("trigger_count"),
        ),
        "edges",
    )
    ends = F.array(*[F.struct(F.lit(end).alias("end"), F.col(f"{end}_at").alias("at"), F.col(f"{end}_seq").alias("seq")) for end in ("first", "last")])
    points = edge.select(*KEY, "episode", "window_us", F.explode(ends).alias("e")).select(
        *KEY, "episode", _floor_div(F.col("e.at"), F.col("window_us")).alias("bin"), "e.seq", "e.end"
    )
    payload = F.struct(
        "rule_order", "rule_id", "alert_id", "title", "description", "mitre_techniques", "evidence",
        "correlation_rule_id",
    )
    at_ends = stage(
        correlation_matches(scored.join(points, [*KEY, "bin", "seq"]), rules, detection, keep=["episode", "seq", "end"])
        .groupBy(*KEY, "episode", "end", "bin", "ts_us", "event_id", "seq")
        .agg(F.first("window_us").alias("window_us"), F.collect_list(payload).alias("found"))
        .withColumn("siblings", F.array_sort("found", lambda a, b: a["rule_order"] - b["rule_order"]))
        .drop("found"),
        "at-ends",
    )
    opening, closing = [at_ends.where(F.col("end") == end).drop("end") for end in ("first", "last")]

    # 3. the first match: earliest alert and founding (smallest) alert id
    first = F.get("siblings", 0)
    lead = opening.select(
        *KEY, "episode", "bin", "window_us", F.col("ts_us").alias("p_ts_us"), F.col("seq").alias("p_seq"),
        first["rule_order"].alias("p_rule_order"), first["alert_id"].alias("p_alert_id"),
    )
    founding = (
        scored.drop("window_us").join(_around(lead), [*KEY, "bin"])
        .where(
            (F.col("ts_us") >= F.col("p_ts_us") - F.col("window_us"))
            & (F.col("seq") <= F.col("p_seq"))
            & ((F.col("alert_id") == F.col("p_alert_id")) | _takes(F.col("asked_by"), F.col("p_rule_order")))
        )
        .groupBy(*KEY, "episode")
        .agg(F.timestamp_micros(F.min("ts_us")).alias("first_seen"), F.min("alert_id").alias("founding_alert_id"))
    )

    # 4. the last trigger that added something decides description and evidence
    last_growing = _last_growing(closing, scored, triggers, use_prior=True)
    closing = (
        closing.join(last_growing, [*KEY, "episode"], "left")
        .withColumn(
            "decisive",
            F.coalesce(
                F.get(F.filter("siblings", lambda s: s["rule_order"] == F.col("growing_order")), 0),
                F.get("siblings", 0),
            ),
        )
        .select(
            *KEY, "episode", F.timestamp_micros("ts_us").alias("last_seen"),
            F.col("decisive.description").alias("description"), F.col("decisive.evidence").alias("evidence"),
        )
    )

    # 5. members: an alert belongs to the episode of a trigger that takes it, in its bin or the next one.
    # One row per bin holds the last and the first trigger of every rule, and the correlation they are in
    # a correlation's key needs its founding alert, so the small episode table joins first
    names = stage(opening.join(founding, [*KEY, "episode"]).select(
        *KEY, "episode", "first_seen", "founding_alert_id",
        short_id("corr-", F.col("correlation_type"), ":", F.col("entity_key"), ":", F.col("founding_alert_id")).alias("correlation_id"),
        first["correlation_rule_id"].alias("rule_id"), first["title"].alias("title"),
        first["mitre_techniques"].alias("mitre_techniques"),
        F.col("event_id").alias("founding_event_id"),
    ), "names")
    reach = stage(
        placed.where("newest is not null").groupBy(*KEY, "bin")
        .agg(F.first("episode").alias("episode"), F.collect_list(F.struct("rule_order", "newest", "lo")).alias("takers"))
        .join(names.select(*KEY, "episode", "correlation_id"), [*KEY, "episode"])
        .select(*KEY, "bin", "correlation_id", "takers"),
        "reach",
    )
    ahead = reach.select(*KEY, (F.col("bin") - 1).alias("bin"), F.col("correlation_id").alias("ahead_id"), F.col("takers").alias("ahead"))

    def takes_here(t: Column) -> Column:
        """An alert isn't taken by itself, but by later ones of its rule."""
        same_rule = t["rule_order"].eqNullSafe(F.col("rule_order"))
        return _takes(F.col("asked_by"), t["rule_order"]) & F.when(same_rule, t["newest"] > F.col("seq")).otherwise(t["newest"] >= F.col("seq"))

    def takes_ahead(t: Column) -> Column:
        return _takes(F.col("asked_by"), t["rule_order"]) & (t["lo"] - F.col("window_us") <= F.col("ts_us"))

    joins_here = F.col("is_trigger") | F.exists("takers", takes_here)
    members = (
        scored.join(reach, [*KEY, "bin"], "left").join(ahead, [*KEY, "bin"], "left")
        .select(
            F.when(joins_here, F.col("correlation_id")).when(F.exists("ahead", takes_ahead), F.col("ahead_id")).alias("correlation_id"),
            *KEY, "alert_id", "event_id", F.timestamp_micros("ts_us").alias("timestamp"), "rule_id", "severity", "dataset_id",
        )
        .where("correlation_id is not null")
    )
    members = stage(members, "members")
    # two levels: alerts of one event first, so a hot episode is counted in parallel
    counts = (
        members.groupBy("correlation_id", "event_id").agg(F.count("*").alias("alerts"))
        .groupBy("correlation_id")
        .agg(F.sum("alerts").alias("alert_count"), F.count("*").alias("event_count"))
    )
    correlations = (
        names.join(closing, [*KEY, "episode"])
        .join(edge.select(*KEY, "episode", "severity", "trigger_count"), [*KEY, "episode"])
        .join(counts, "correlation_id")
        .select(
            "correlation_id", "rule_id", *KEY, "title", "description", "severity", F.lit("open").alias("status"),
            "first_seen", "last_seen", "alert_count", "event_count", "trigger_count", "mitre_techniques",
            "evidence", "founding_alert_id", "founding_event_id",
        )
    )
    if not compat:
        techniques = F.array(*[
            F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(m).alias("m")) for r in detection for m in r.mitre
        ])
        union = (
            members.select("correlation_id", "rule_id").distinct()
            .select("correlation_id", F.explode(F.filter(techniques, lambda t: t["rule_id"] == F.col("rule_id"))["m"]).alias("m"))
            .groupBy("correlation_id").agg(F.array_sort(F.collect_set("m")).alias("all_mitre"))
        )
        correlations = correlations.join(union, "correlation_id", "left").withColumn(
            "mitre_techniques",
            F.array_sort(F.array_union("mitre_techniques", F.coalesce("all_mitre", F.array().cast("array<string>")))),
        ).drop("all_mitre")

    # 6. what each event did (C11): the founding event creates, every other trigger event updates;
    # the founding event also updates when a later trigger of it adds alerts
    also = (
        _last_growing(opening, scored, triggers, use_prior=False)
        .join(opening.select(*KEY, "episode", F.get("siblings", 0)["rule_order"].alias("first_order")), [*KEY, "episode"])
        .where("growing_order > first_order")
        .join(names.select(*KEY, "episode", "correlation_id", "founding_event_id"), [*KEY, "episode"])
        .select(F.col("founding_event_id").alias("event_id"), "correlation_id", F.lit("updated").alias("outcome"))
    )
    numbered = scored.where("partners > 0").select(*KEY, "bin", "event_id", "alert_id").join(bins, [*KEY, "bin"])
    touched = (
        numbered.select(*KEY, "episode", "event_id").distinct()
        .join(names.select(*KEY, "episode", "correlation_id", "founding_event_id"), [*KEY, "episode"])
        .select(
            "event_id", "correlation_id",
            F.when(F.col("event_id") == F.col("founding_event_id"), "created").otherwise("updated").alias("outcome"),
        )
    )
    triggering = numbered.join(names.select(*KEY, "episode", "correlation_id"), [*KEY, "episode"]).select(
        "correlation_id", "alert_id"
    )
    return Correlations(correlations, members, touched.unionByName(also), triggering)


def correlate_increment(
    new: DataFrame, history: DataFrame, stored: DataFrame, stored_members: DataFrame,
    rules: Sequence[CorrelationRule] | None = None, detection: Sequence[DetectionRule] = BUILTIN_RULES,
) -> Correlations | None:
    """What later alerts do to stored correlations; the same result as one batch over all.

    Only alerts from two windows before the first new one are read again: an episode that
    goes on has a trigger within one window of the new ones, and that trigger needs its own
    window. ``correlations`` holds the new and the changed rows, ``members`` the added ones.
    """
    rules = all_rules(detection) if rules is None else list(rules)
    start = new.agg(F.min("timestamp").alias("t")).first()["t"]
    if start is None:
        return None
    widest = max(r.window_seconds for r in rules)
    since = F.lit(start) - F.make_dt_interval(secs=F.lit(2 * widest))
    region = new.withColumn("is_new", F.lit(True)).unionByName(
        history.where(F.col("timestamp") >= since).withColumn("is_new", F.lit(False)).select(*new.columns, "is_new")
    )
    parts = stage(participations(region, rules, detection, keep=["is_new"]), "increment")
    first_us = F.unix_micros(F.lit(start))
    scored = score_participations(parts).withColumn(
        "is_trigger", (F.col("partners") > 0) & (F.col("ts_us") >= first_us - F.col("window_us"))
    )
    found = episodes(stage(scored, "increment-scored"), rules, detection)
    fresh = new.select("alert_id").withColumn("is_new", F.lit(True))
    members = found.members.join(fresh, "alert_id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
    changed = members.where("is_new").select("correlation_id").distinct()
    known = stored_members.where(F.col("timestamp") >= since).select(
        "correlation_type", "alert_id", F.col("correlation_id").alias("stored_id")
    )
    # the region's correlation -> the stored one it continues
    continues = (
        members.join(changed, "correlation_id", "left_semi").join(known, ["correlation_type", "alert_id"])
        .groupBy("correlation_id").agg(F.min("stored_id").alias("stored_id"))
    )
    names = stage(changed.join(continues, "correlation_id", "left"), "increment-names")
    final = F.coalesce("stored_id", "correlation_id")
    added = (
        members.join(names, "correlation_id").withColumn("correlation_id", final)
        .join(stored_members.select("correlation_id", "alert_id"), ["correlation_id", "alert_id"], "left_anti")
        .select(*found.members.columns)
    )
    added = stage(added, "increment-members")
    seen = stored_members.where(F.col("timestamp") >= since).select("correlation_id", "event_id").distinct()
    grown = (
        added.groupBy("correlation_id").agg(F.count("*").alias("more_alerts"))
        .join(
            added.select("correlation_id", "event_id").distinct().join(seen, ["correlation_id", "event_id"], "left_anti")
            .groupBy("correlation_id").agg(F.count("*").alias("more_events")),
            "correlation_id", "left",
        )
    )
    new_triggers = (
        found.triggers.join(fresh, "alert_id", "left_semi").join(names, "correlation_id").withColumn("correlation_id", final)
        .groupBy("correlation_id").agg(F.count("*").alias("more_triggers"))
    )
    old = stored.select(*[F.col(c).alias(f"old_{c}") for c in stored.columns])
    rows = (
        found.correlations.join(names, "correlation_id")
        .withColumn("correlation_id", final)
        .join(old, F.col("correlation_id") == F.col("old_correlation_id"), "left")
        .join(grown, "correlation_id", "left").join(new_triggers, "correlation_id", "left")
    )
    stays = ["title", "first_seen", "mitre_techniques", "founding_alert_id", "founding_event_id", "status", "rule_id"]

    def column(c: str) -> Column:
        if c in stays:
            return F.when(F.col("stored_id").isNotNull(), F.col(f"old_{c}")).otherwise(F.col(c)).alias(c)
        if c == "severity":
            return F.greatest("severity", "old_severity").alias(c)
        more = {"alert_count": "more_alerts", "event_count": "more_events", "trigger_count": "more_triggers"}.get(c)
        if more:
            return F.when(
                F.col("stored_id").isNotNull(), F.col(f"old_{c}") + F.coalesce(F.col(more), F.lit(0))
            ).otherwise(F.col(c)).alias(c)
        return F.col(c)

    changed_rows = rows.select(*[column(c) for c in found.correlations.columns])
    touched = (
        found.outcomes.join(names, "correlation_id")
        .join(new.select("event_id").distinct(), "event_id", "left_semi")
        .select(
            "event_id", final.alias("correlation_id"),
            F.when(F.col("stored_id").isNotNull(), "updated").otherwise(F.col("outcome")).alias("outcome"),
        )
        .distinct()
    )
    return Correlations(changed_rows, added, touched)

