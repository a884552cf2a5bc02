"""Reserved-capacity alarm controller with delayed settlement.

An alarm reserves one bin of its entity-month until its horizon has passed.  It
then settles as a confirmed false bin, stays charged when the follow-up was
censored, or is released when an event arrives inside the horizon.  Budgets are
coupled so that the alarms of a smaller budget are alarms of every larger one.

The recursion is genuine (a release depends on which segments were accepted), so
the panel is stepped through in time.  :class:`EntityController` is the machine of
one entity, which the streaming operator steps; over a whole panel the same
decisions are taken for blocks of entities side by side (:mod:`controller_block`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.functions import clock, trajectory
from tidewatch.operators import controller_block
from tidewatch.operators.policies import capacity_bins


@dataclass(frozen=True)
class ControllerRules:
    step_minutes: int = 10
    horizon_steps: int = 36
    method: str = "dynamic"  # dynamic | uniform_pacing | dual_mirror_descent | switch_over
    utility: str = "linear"
    score_threshold: float = 0.1
    use_lead_utility: bool = True
    use_price: bool = True
    use_remaining_time: bool = True
    price_initial: float = 0.0
    price_rate: float = 1.0
    pending_pressure: float = 0.5
    reserve: bool = True
    release: bool = True
    couple: bool = True
    dedup_bins: int = 0
    pacing_slack: int = 1
    dual_step_scale: float = 1.0
    dual_initial_price: float = 0.0
    switch_high: float = 0.5
    switch_low: float = 0.25
    switch_fraction: float = 0.5

    @property
    def step(self) -> int:
        return self.step_minutes * 60

    @property
    def horizon(self) -> int:
        return self.step * self.horizon_steps


def variants(base: ControllerRules) -> dict[str, ControllerRules]:
    """Named controller variants: baselines first, then the ablations of the full controller."""
    return {
        "dynamic": base,
        "uniform_pacing": replace(base, method="uniform_pacing", use_price=False),
        "risk_greedy": replace(base, use_lead_utility=False, use_price=False),
        "static_utility": replace(base, use_price=False),
        "dual_mirror_descent": replace(base, method="dual_mirror_descent", use_price=False),
        "switch_over": replace(base, method="switch_over", use_price=False),
        "no_lead_utility": replace(base, use_lead_utility=False),
        "risk_as_utility": replace(base, utility="risk"),
        "no_remaining_time": replace(base, use_remaining_time=False),
        "no_pending_pressure": replace(base, pending_pressure=0.0),
        "no_release": replace(base, release=False),
        "no_reserve": replace(base, reserve=False),
        "uncoupled": replace(base, couple=False),
        "dedup": replace(base, dedup_bins=base.horizon_steps),
    }


class Decision(NamedTuple):
    """What one budget decided at one step, and its account afterwards."""

    budget: float
    score: float
    bar: float
    desired: int
    alarm: int
    confirmed: int
    pending: int
    occupied: int
    capacity: int
    price: float


@dataclass
class Ledger:
    """Account of one budget in one calendar month."""

    capacity: int
    bins: int
    price: float
    confirmed: int = 0
    pending: int = 0
    locked: int = 0
    released: int = 0
    actions: int = 0
    peak_pending: int = 0
    peak_occupied: int = 0
    peak_unlocked: int = 0
    rejected_capacity: int = 0
    rejected_pacing: int = 0
    last_bin: int = -1

    @property
    def occupied(self) -> int:
        return self.confirmed + self.pending + self.locked

    def note_peak(self) -> None:
        used = self.confirmed + self.pending
        if self.pending > self.peak_pending:
            self.peak_pending = self.pending
        if used > self.peak_unlocked:
            self.peak_unlocked = used
        if used + self.locked > self.peak_occupied:
            self.peak_occupied = used + self.locked


@dataclass
class Account:
    """State of one budget of one entity: monthly ledgers and open reservations."""

    ledgers: dict[str, Ledger] = field(default_factory=dict)
    # Open reservations in issue order: [issue, month, follow-up seen, segment].
    open: list[list] = field(default_factory=list)
    last_action: int | None = None
    segment: int = 0


class EntityController:
    """All budgets of one entity, stepped in time order."""

    def __init__(self, rules: ControllerRules, budgets: tuple[float, ...]):
        self.rules = rules
        self.budgets = tuple(sorted(set(budgets)))
        if not self.budgets:
            raise ValueError("at least one budget is needed")
        self.capacities = [capacity_bins(b, rules.step_minutes) for b in self.budgets]
        self.accounts = [Account() for _ in self.budgets]

    # -- settlement ---------------------------------------------------------
    def event(self, onset: int) -> None:
        """An onset frees the earliest segment that foresaw it, once per budget.

        What the window holds of that segment leaves the queue, and the rest is older than any later window, so a segment cannot be
        freed twice and none has to be remembered.
        """
        earliest = onset - self.rules.horizon
        for account in self.accounts:
            account.last_action = None
            foreseeing = [r for r in account.open if earliest <= r[0] < onset]
            if not foreseeing:
                continue
            winner = min(r[3] for r in foreseeing)
            freed = [r for r in foreseeing if r[3] == winner]
            account.open = [r for r in account.open if not (r[3] == winner and earliest <= r[0] < onset)]
            for _, month, _, _ in freed:
                ledger = account.ledgers[month]
                ledger.pending -= self.rules.reserve
                if self.rules.release:
                    ledger.released += 1
                else:
                    ledger.locked += 1
            for month in {r[1] for r in freed}:
                account.ledgers[month].note_peak()

    def mature(self, now: int) -> None:
        """Reservations whose horizon has passed leave the queue; observed ones become false bins."""
        limit = now - self.rules.horizon
        for account in self.accounts:
            queue = account.open
            if not queue or queue[0][0] > limit:
                continue
            due = 0
            touched = set()
            while due < len(queue) and queue[due][0] <= limit:
                _, month, seen, _ = queue[due]
                due += 1
                touched.add(month)
                if seen:
                    ledger = account.ledgers[month]
                    ledger.pending -= self.rules.reserve
                    ledger.confirmed += 1
            del queue[:due]
            for month in touched:
                account.ledgers[month].note_peak()

    # -- decision -----------------------------------------------------------
    def _judge(self, ledger: Ledger, risk: float, utility: float, elapsed: float, bin_index: int) -> tuple[float, float, bool]:
        r = self.rules
        if r.method == "dual_mirror_descent":
            idle = bin_index - ledger.last_bin - 1
            if idle > 0:
                rate, eta = self._dual(ledger)
                ledger.price = max(0.0, ledger.price - eta * rate * idle)
            score = min(max(utility / (r.step_minutes * r.horizon_steps / 60.0), 0.0), 1.0)
            return score, ledger.price, score > ledger.price
        if r.method == "switch_over":
            bar = r.switch_high if elapsed < r.switch_fraction else r.switch_low
            return utility, bar, utility >= bar
        score = utility if r.use_lead_utility else risk
        bar = r.score_threshold
        if r.use_price and ledger.capacity > 0:
            share = 1.0 / ledger.capacity
            drift = ledger.occupied * share - (elapsed if r.use_remaining_time else 0.5)
            push = r.price_initial + r.price_rate * drift + r.pending_pressure * ledger.pending * share
            bar *= math.exp(min(max(push, -12.0), 12.0))
        return score, bar, score >= bar

    def _dual(self, ledger: Ledger) -> tuple[float, float]:
        bins = max(ledger.bins, 1)
        return ledger.capacity / bins, self.rules.dual_step_scale / math.sqrt(bins)

    def decide(self, now: int, month: str, month_bins: int, bin_index: int, elapsed: float, risk: float, utility: float,
               seen: bool, given: tuple[bool | None, ...] | None = None) -> list[Decision]:
        """Decision of every budget at ``now``; ``given`` replaces the policy's own candidates."""
        r = self.rules
        views, wants, rooms = [], [], []
        for i, account in enumerate(self.accounts):
            ledger = account.ledgers.get(month)
            if ledger is None:
                ledger = account.ledgers[month] = Ledger(self.capacities[i], month_bins, r.dual_initial_price)
            score, bar, want = self._judge(ledger, risk, utility, elapsed, bin_index)
            if given is not None and given[i] is not None:
                want = bool(given[i])
            if want and r.dedup_bins and account.last_action is not None:
                want = now - account.last_action >= r.dedup_bins * r.step
            if r.method == "uniform_pacing" and want:
                allowed = min(ledger.capacity, math.floor(elapsed * ledger.capacity) + r.pacing_slack)
                if ledger.occupied + 1 > allowed:
                    ledger.rejected_pacing += 1
                    want = False
            views.append((ledger, score, bar))
            wants.append(want)
            rooms.append(ledger.occupied + r.reserve <= ledger.capacity)
        accepted = self._couple(wants, rooms)
        return [self._book(i, now, month, seen, bin_index, views[i], wants[i], accepted[i]) for i in range(len(views))]

    def _couple(self, wants: list[bool], rooms: list[bool]) -> list[bool]:
        """Larger budgets inherit smaller ones' wishes; a wish needs room in every budget above it."""
        if not self.rules.couple:
            return [w and room for w, room in zip(wants, rooms)]
        inherited = False
        for i, want in enumerate(wants):
            inherited = wants[i] = inherited or want
        clear = True
        accepted = [False] * len(wants)
        for i in reversed(range(len(wants))):
            clear = clear and rooms[i]
            accepted[i] = wants[i] and clear
        return accepted

    def _book(self, i: int, now: int, month: str, seen: bool, bin_index: int, view, want: bool, accepted: bool) -> Decision:
        r, account = self.rules, self.accounts[i]
        ledger, score, bar = view
        if accepted:
            ledger.actions += 1
            if account.last_action is None or now - account.last_action > r.step:
                account.segment += 1
            account.last_action = now
            account.open.append([now, month, seen, account.segment])
            ledger.pending += r.reserve
            ledger.note_peak()
            if r.reserve and ledger.occupied > ledger.capacity:
                raise RuntimeError("hard budget exceeded")
        elif want:
            ledger.rejected_capacity += 1
        if r.method == "dual_mirror_descent":
            rate, eta = self._dual(ledger)
            ledger.price = max(0.0, ledger.price + eta * (float(want) - rate))
            ledger.last_bin = bin_index
        return Decision(self.budgets[i], score, bar, int(want), int(accepted), ledger.confirmed, ledger.pending, ledger.occupied, ledger.capacity, ledger.price)

    # -- reporting and persistence -------------------------------------------
    def months(self) -> list[dict]:
        return [{"budget": b, "month": m, **asdict(ledger)}
                for b, account in zip(self.budgets, self.accounts) for m, ledger in account.ledgers.items()]

    def dump(self) -> list:
        return [[{m: asdict(x) for m, x in a.ledgers.items()}, a.open, a.last_action, a.segment] for a in self.accounts]

    def forget_closed_months(self, current: str) -> None:
        """Drop ledgers of past months without an open reservation; a stream has emitted all they decided."""
        for account in self.accounts:
            kept = {current, *(r[1] for r in account.open)}
            account.ledgers = {m: x for m, x in account.ledgers.items() if m in kept}

    def load(self, saved: list) -> EntityController:
        self.accounts = [Account({m: Ledger(**x) for m, x in led.items()}, queue, last, seg) for led, queue, last, seg in saved]
        return self


_TRACE = ("entity {k}, t bigint, budget double, score double, bar double, desired bigint, alarm bigint, confirmed bigint, "
          "pending bigint, occupied bigint, capacity bigint, price double, risk double, utility double")
_MONTH = ("month string, actions bigint, released bigint, locked bigint, peak_pending bigint, peak_occupied bigint, "
          "peak_unlocked bigint, rejected_capacity bigint, rejected_pacing bigint, bins bigint")


#: What a decision needs to know of a row, beside whether its follow-up was observed.
INPUTS = ("entity", "t", "month", "month_bins", "bin_index", "elapsed", "risk", "utility")
#: Rows after which a block of whole entities is decided, and rows of a batch that is handed back.
BLOCK_ROWS, BATCH_ROWS = 1 << 18, 1 << 15


def with_decision_inputs(df: DataFrame, hazard: str, rules: ControllerRules) -> DataFrame:
    """Risk, lead utility and calendar position of each row, computed on the JVM."""
    start, end = clock.month_start("t"), clock.month_end("t")
    return df.withColumns({
        "risk": trajectory.risk_at(hazard, rules.horizon_steps),
        # "risk" is the ablation that ignores lead time altogether.
        "utility": trajectory.risk_at(hazard, rules.horizon_steps) if rules.utility == "risk" else trajectory.trajectory_value(
            hazard, rules.step_minutes, rules.horizon_steps, rules.utility),
        "month": clock.month_key("t"), "month_bins": F.floor((end - start) / rules.step),
        "bin_index": F.floor((F.col("t") - start) / rules.step),
        "elapsed": (F.col("t") - start) / (end - start),
    })


def _with_lead_values(rows: DataFrame, hazard: str, suffix: dict[tuple[str, int], str], rules: ControllerRules) -> DataFrame:
    """Decision inputs of each (utility, horizon), whose risk and utility bear its suffix."""
    out = rows.withColumn("_hazard", F.expr(hazard))
    for (utility, steps), k in suffix.items():
        out = with_decision_inputs(out, "_hazard", replace(rules, utility=utility, horizon_steps=steps)).withColumnsRenamed({"risk": f"risk{k}", "utility": f"utility{k}"})
    return out


def run_controller(rows: DataFrame, events: DataFrame, budgets: tuple[float, ...], rules: ControllerRules,
                   observed: str = "observed", given: dict[float, str] | None = None, trace: str = "all") -> DataFrame:
    """Decision trace and month audit of every entity, as tagged rows (``kind`` t or m).

    ``trace`` keeps every decision, only the accepted ones (``alarms``), or ``none``.

    ``rows`` carries the inputs of :func:`with_decision_inputs`; ``events`` has
    (entity, onset).  ``given`` names candidate columns that replace the policy.
    """
    return run_controllers(rows, events, budgets, {"": rules}, observed, given, trace).drop("method")


def run_controllers(rows: DataFrame, events: DataFrame, budgets: tuple[float, ...], rules: dict[str, ControllerRules],
                    observed: str = "observed", given: dict[float, str] | None = None, trace: str = "all", hazard: str | None = None) -> DataFrame:
    """As :func:`run_controller` for several rule sets over the same rows, tagged by ``method``: an entity's rows are read and ordered once.

    With ``hazard``, an expression over the other columns of ``rows``, the inputs are worked out after the rows were placed and ordered, so that
    no more moves than the hazard is made of, and rule sets may differ in horizon and lead value.
    """
    budgets = tuple(sorted(set(budgets)))
    # What a rule set decides by: the same for all, or one risk and utility per horizon and lead value.
    lead = {n: (r.utility, r.horizon_steps) if hazard else None for n, r in rules.items()}
    suffix = {k: "" if k is None else f"_{i}" for i, k in enumerate(dict.fromkeys(lead.values()))}
    if hazard and len({r.step_minutes for r in rules.values()}) > 1:
        raise ValueError("rule sets of one pass have the same step")
    if not budgets:
        raise ValueError("at least one budget is needed")
    given = given or {}
    kind = dict(rows.dtypes)["entity"]
    schema = "method string, kind string, " + _TRACE.format(k=kind) + ", " + _MONTH + ", seen bigint"
    fields_ = [f.split(" ") for f in schema.split(", ")]
    types = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
    entity_type = to_arrow_type(rows.schema["entity"].dataType)
    arrow = pa.schema([(n, entity_type if n == "entity" else types[k]) for n, k in fields_])
    known = events.filter("onset IS NOT NULL").groupBy(F.col("entity").alias("_who")).agg(F.collect_list("onset").alias("_onsets"))
    seen = F.coalesce(F.col(observed), F.lit(0)).cast("int").alias("seen")
    needed = rows.select(*([c for c in rows.columns if c != observed] if hazard else [*INPUTS, *sorted(set(given.values()))]), seen)
    joined = needed.join(known, F.col("entity").eqNullSafe(F.col("_who")), "left").drop("_who")
    # The window places an entity's rows in one partition, in order; its first row carries the onsets.
    first = F.row_number().over(Window.partitionBy("entity").orderBy("t")) == 1
    ordered = joined.withColumn("_first", first).withColumn("_onsets", F.when(F.col("_first"), F.col("_onsets"))).sortWithinPartitions("entity", "t")
    if hazard:
        ordered = _with_lead_values(ordered, hazard, suffix, next(iter(rules.values()))).select("entity", *[c for c in INPUTS[1:] if c not in ("risk", "utility")], *[f"{c}{k}" for k in suffix.values() for c in ("risk", "utility")],
                                                                       "seen", *sorted(set(given.values())), "_first", "_onsets")

    def decide(block: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        inputs = (*[c for c in INPUTS[1:] if c not in ("risk", "utility")], *[f"{c}{k}" for k in suffix.values() for c in ("risk", "utility")], "seen")
        empty = [c for c in inputs if block.column(c).null_count]
        if empty:
            raise ValueError(f"rows without {', '.join(empty)} cannot be decided")
        block = block.combine_chunks()
        month = block.column("month").combine_chunks().dictionary_encode()
        columns = {c: block.column(c).to_numpy() for c in inputs if c != "month"}
        columns |= {"month": month.indices.to_numpy().astype(np.int64), "seen": columns["seen"] >= 1}
        columns = {c: v.astype(float) if c == "elapsed" or c.startswith(("risk", "utility")) else v for c, v in columns.items()}
        columns_ = columns
        shared = {c: v for c, v in columns.items() if not c.startswith(("risk", "utility"))}
        onsets = [np.array(x or (), dtype=np.int64) for x in block.column("_onsets").take(pa.array(starts)).to_pylist()]
        masks = [block.column(given[b]).cast(pa.float64()).fill_null(0.0).to_numpy() != 0 if b in given else None for b in budgets] if given else None
        names, entity, width = pa.array(month.dictionary), block.column("entity"), len(budgets)
        panels: dict[int, controller_block.Panel] = {}
        for method, rule in rules.items():
            if rule.horizon not in panels:
                panels[rule.horizon] = controller_block.Panel(shared, starts, onsets, rule.horizon)
            k = suffix[lead[method]]
            columns = shared | {c: columns_[f"{c}{k}"] for c in ("risk", "utility")}
            panel = panels[rule.horizon].beside(columns)
            capacities = [capacity_bins(x, rule.step_minutes) for x in budgets]
            machine = controller_block.Block(rule, capacities, panel, len(names))
            made = machine.run(masks, trace != "none")

            def table(kind_: str, at: np.ndarray, which: np.ndarray, values: dict[str, pa.Array | np.ndarray]) -> Iterator[pa.RecordBatch]:
                values |= {"method": pa.repeat(method, len(at)), "kind": pa.repeat(kind_, len(at)), "entity": entity.take(pa.array(at)).combine_chunks(),
                           "budget": np.array(budgets, dtype=float)[which], "capacity": np.array(capacities, dtype=np.int64)[which]}
                whole = [pa.array(values[f.name], f.type) if f.name in values else pa.nulls(len(at), f.type) for f in arrow]
                yield from pa.Table.from_arrays(whole, schema=arrow).to_batches(max_chunksize=BATCH_ROWS)

            if made:
                kept = np.ones(made["alarm"].shape, dtype=bool) if trace == "all" else made["alarm"] == 1
                at, which = np.nonzero(kept)
                yield from table("t", at, which, {n: v[kept] for n, v in made.items()} | {c: columns[c][at] for c in ("t", "risk", "utility", "seen")})
            ledgers = np.repeat(np.flatnonzero(machine.known), width)
            which = np.tile(np.arange(width), len(ledgers) // width)
            yield from table("m", panel.starts[ledgers % machine.entities], which, {n: v[ledgers, which] for n, v in machine.ledger.items()} | {
                "month": names.take(pa.array(ledgers // machine.entities)), "bins": machine.bins[ledgers], "price": machine.price[ledgers, which],
                "occupied": sum(machine.ledger[n][ledgers, which] for n in ("confirmed", "pending", "locked"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, goal = 0, BLOCK_ROWS
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < goal:
                continue
            whole = pa.Table.from_batches(held)
            starts = np.flatnonzero(whole.column("_first").to_numpy())
            # The last entity may go on in the next batch.
            if starts[-1] > 0:
                yield from decide(whole.slice(0, starts[-1]), starts[:-1])
            held = whole.slice(starts[-1]).to_batches()
            size = whole.num_rows - int(starts[-1])
            goal = max(BLOCK_ROWS, 2 * size)
        if size:
            whole = pa.Table.from_batches(held)
            yield from decide(whole, np.flatnonzero(whole.column("_first").to_numpy()))

    return ordered.mapInArrow(run, schema)


def _tags(result: DataFrame) -> list[str]:
    return ["method"] if "method" in result.columns else []


def trace_of(result: DataFrame) -> DataFrame:
    return result.filter("kind = 't'").select(*_tags(result), *[f.split(" ")[0] for f in _TRACE.split(", ")])


def alarms_of(result: DataFrame) -> DataFrame:
    """Accepted decisions, with whether their follow-up was observed."""
    return result.filter("kind = 't' AND alarm = 1").select(*_tags(result), "budget", "entity", "t", "alarm", F.col("seen").alias("observed"))


def months_of(result: DataFrame) -> DataFrame:
    """Month audit: ledger totals, peaks and whether the hard budget held."""
    names = [f.split(" ")[0] for f in _MONTH.split(", ")]
    return result.filter("kind = 'm'").select(
        *_tags(result), "entity", "budget", *names, "confirmed", F.col("pending").alias("unsettled"), "capacity", "price",
        (F.col("peak_occupied") <= F.col("capacity")).cast("int").alias("hard_budget_met"))


def alarms_wide(trace: DataFrame, budgets: tuple[float, ...]) -> DataFrame:
    """One row per (entity, t) with an alarm column per budget."""
    return trace.groupBy("entity", "t").agg(*[
        F.max(F.when(F.col("budget") == b, F.col("alarm"))).alias(f"alarm_{b:g}h") for b in sorted(set(budgets))])
