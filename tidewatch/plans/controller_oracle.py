"""Oracle of the reserved-capacity controller: one recursion per rule set over rows and onsets in time order.

The state of an entity is a list with one struct per budget: its open reservations and, as lists over the calendar months, the
counters of its ledgers.
"""

from __future__ import annotations

from tidewatch.operators.controller import ControllerRules
from tidewatch.operators.policies import capacity_bins
from tidewatch.plans.registry import cte

_FIELDS = "confirmed pending locked released actions peak_pending peak_occupied rejected".split()


def _items(name: str, rules: ControllerRules, weights: list[float], given: dict[int, str]) -> str:
    steps = rules.horizon_steps
    alive, value = "1.0::DOUBLE", "0.0::DOUBLE"
    for k in range(1, steps + 1):
        alive = f"({alive} * (1.0::DOUBLE - h[{k}]))"
    for k, w in reversed(list(enumerate(weights, 1))):
        value = f"(h[{k}] * {w}::DOUBLE + (1.0::DOUBLE - h[{k}]) * {value})"
    risk = f"(1.0::DOUBLE - {alive})"
    masks = ", ".join(f"CASE WHEN {given[i]} THEN true ELSE false END" if i in given else "NULL::BOOLEAN" for i in range(8) if i < max([0, *given]) + 1)
    cte(f"{name}_items", f"""SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t, is_row) AS n FROM (
 SELECT entity, t, 1 AS is_row, dense_rank() OVER (ORDER BY ms) AS mi, ms, (me-ms)//{rules.step} AS bins, (t-ms)//{rules.step} AS bin_index, (t-ms)/(me-ms) AS elapsed,
 {risk} AS risk, {risk if rules.utility == 'risk' else value} AS utility, observed=1 AS seen, [{masks}]::BOOLEAN[] AS given
 FROM (SELECT *, epoch_us(date_trunc('month', make_timestamp(t*1000000)))//1000000 AS ms, epoch_us(date_trunc('month', make_timestamp(t*1000000)) + INTERVAL 1 MONTH)//1000000 AS me FROM traj)
 UNION ALL SELECT o.entity, o.onset, 0, 1, 0, 1, 0, 0.0, 0.0, 0.0, false, []::BOOLEAN[] FROM onsets o JOIN (SELECT entity, max(t) AS z FROM traj GROUP BY 1) l ON l.entity=o.entity AND o.onset<=l.z)""", "traj onsets")
    return f"{name}_items"


def _judge(r: ControllerRules) -> tuple[str, str, str]:
    """Score, bar and wish of budget ``b`` at an item."""
    at = lambda f: f"list_element(b.{f}, mi)"
    occupied = f"({at('confirmed')} + {at('pending')} + {at('locked')})"
    if r.method == "dual_mirror_descent":
        return f"least(greatest(utility / {r.step_minutes * r.horizon_steps / 60.0}::DOUBLE, 0.0), 1.0)", "b.price", "score > bar"
    if r.method == "switch_over":
        return "utility", f"CASE WHEN elapsed < {r.switch_fraction}::DOUBLE THEN {r.switch_high}::DOUBLE ELSE {r.switch_low}::DOUBLE END", "score >= bar"
    bar = f"{r.score_threshold}::DOUBLE"
    if r.use_price:
        now = "elapsed" if r.use_remaining_time else "0.5::DOUBLE"
        push = f"{r.price_initial}::DOUBLE + {r.price_rate}::DOUBLE * ({occupied} * (1.0::DOUBLE / b.cap) - {now}) + {r.pending_pressure}::DOUBLE * {at('pending')} * (1.0::DOUBLE / b.cap)"
        bar = f"CASE WHEN b.cap > 0 THEN {bar} * exp(least(greatest({push}, -12.0::DOUBLE), 12.0::DOUBLE)) ELSE {bar} END"
    return "utility" if r.use_lead_utility else "risk", bar, "score >= bar"


def controller_cte(name: str, rules: ControllerRules, budgets: tuple[float, ...], weights: list[float], given: dict[int, str] | None = None) -> None:
    """Register ``name``: the state after every item; ``given`` maps a budget's place (from 0) to a condition that replaces its own wish."""
    r, given = rules, given or {}
    items = _items(name, r, weights, given)
    reserve, horizon, count = int(r.reserve), r.horizon, len(budgets)
    zeros = "list_transform(range(m.months), lambda z: 0::BIGINT)"
    start = ", ".join(
        f"{{'budget': {float(b)}::DOUBLE, 'cap': {capacity_bins(b, r.step_minutes)}::BIGINT, 'open': []::STRUCT(a BIGINT, m BIGINT, s BOOLEAN, g BIGINT)[], 'last': NULL::BIGINT, 'seg': 0::BIGINT, "
        f"'price': 0.0::DOUBLE, 'priced': 0::BIGINT, 'last_bin': -1::BIGINT, " + ", ".join(f"'{f}': {zeros}" for f in _FIELDS) +
        ", 'score': 0.0::DOUBLE, 'bar': 0.0::DOUBLE, 'want': false, 'alarm': false}" for b in budgets)
    foresaw = f"q.a >= t - {horizon} AND q.a < t"
    gone = (f"CASE WHEN is_row = 1 THEN list_filter(b.open, lambda q: q.a <= t - {horizon}) ELSE list_filter(b.open, lambda q: {foresaw} AND "
            f"q.g = list_min(list_transform(list_filter(b.open, lambda w: w.a >= t - {horizon} AND w.a < t), lambda w: w.g))) END")
    counted = "list_transform(range(1, len(x.b.confirmed) + 1), lambda k: len(list_filter(x.gone, lambda q: q.m = k AND (is_row = 0 OR q.s)))::BIGINT)"

    def moved(f: str, sign: str, when: str) -> str:
        return f"list_transform(y.b.{f}, lambda v, k: v {sign} CASE WHEN {when} THEN list_element(y.c, k) ELSE 0 END)"

    eta, rate = f"({r.dual_step_scale}::DOUBLE / sqrt(bins::DOUBLE))", "(b.cap / bins)"
    dual = r.method == "dual_mirror_descent"
    settled = ", ".join([
        "'budget': y.b.budget", "'cap': y.b.cap", "'open': list_filter(y.b.open, lambda q: NOT list_contains(list_transform(y.gone, lambda w: w.a), q.a))",
        "'last': CASE WHEN is_row = 1 THEN y.b.last END", "'seg': y.b.seg",
        # A month's price starts anew; idle bins since the last decision lower it.
        f"'price': CASE WHEN is_row = 0 THEN y.b.price WHEN y.b.priced <> mi THEN greatest(0.0, {r.dual_initial_price}::DOUBLE - {eta.replace('b.', 'y.b.')} * {rate.replace('b.', 'y.b.')} * bin_index) "
        f"WHEN bin_index - y.b.last_bin - 1 > 0 THEN greatest(0.0, y.b.price - {eta.replace('b.', 'y.b.')} * {rate.replace('b.', 'y.b.')} * (bin_index - y.b.last_bin - 1)) ELSE y.b.price END" if dual else "'price': y.b.price",
        "'priced': CASE WHEN is_row = 1 THEN mi ELSE y.b.priced END", "'last_bin': y.b.last_bin",
        f"'confirmed': {moved('confirmed', '+', 'is_row = 1')}", f"'pending': {moved('pending', f'- {reserve} *', 'true')}",
        f"'locked': {moved('locked', '+', 'is_row = 0' if not r.release else 'false')}", f"'released': {moved('released', '+', 'is_row = 0' if r.release else 'false')}",
        *[f"'{f}': y.b.{f}" for f in _FIELDS[4:]]])
    score, bar, wish = _judge(r)
    occupied = "(list_element(b.confirmed, mi) + list_element(b.pending, mi) + list_element(b.locked, mi))"
    rules_out = []
    if r.dedup_bins:
        rules_out.append(f"(b.last IS NULL OR t - b.last >= {r.dedup_bins * r.step})")
    if r.method == "uniform_pacing":
        rules_out.append(f"{occupied} + 1 <= least(b.cap, CAST(floor(elapsed * b.cap) AS BIGINT) + {r.pacing_slack})")
    own = f"coalesce(list_element(given, j), {wish})" if given else wish
    wants = " AND ".join([f"({own.replace('score', 'list_element(scores, j)').replace('bar', 'list_element(bars, j)')})", *rules_out])
    inherit = "list_transform(wants, lambda w, j: len(list_filter(wants[1:j], lambda z: z)) > 0)" if r.couple else "wants"
    room = f"len(list_filter(rooms[j:{count}], lambda z: NOT z)) = 0" if r.couple else "list_element(rooms, j)"
    booked_segment = f"b.seg + CASE WHEN list_element(acc, j) AND (b.last IS NULL OR t - b.last > {r.step}) THEN 1 ELSE 0 END"

    def plus(f: str, when: str, amount: int = 1) -> str:
        return f"list_transform(b.{f}, lambda v, k: v + CASE WHEN k = mi AND ({when}) THEN {amount} ELSE 0 END)"

    took = "list_element(acc, j)"
    after = f"list_element(b.pending, k) + CASE WHEN k = mi AND {took} THEN {reserve} ELSE 0 END"
    booked = ", ".join([
        "'budget': b.budget", "'cap': b.cap", f"'open': CASE WHEN {took} THEN list_append(b.open, {{'a': t, 'm': mi, 's': seen, 'g': {booked_segment}}}) ELSE b.open END",
        f"'last': CASE WHEN {took} THEN t ELSE b.last END", f"'seg': {booked_segment}",
        f"'price': greatest(0.0, b.price + {eta} * (CASE WHEN list_element(final, j) THEN 1.0 ELSE 0.0 END::DOUBLE - {rate}))" if dual else "'price': b.price",
        "'priced': b.priced", "'last_bin': bin_index", "'confirmed': b.confirmed", f"'pending': {plus('pending', took, reserve)}", "'locked': b.locked", "'released': b.released",
        f"'actions': {plus('actions', took)}", f"'peak_pending': list_transform(b.peak_pending, lambda v, k: greatest(v, {after}))",
        f"'peak_occupied': list_transform(b.peak_occupied, lambda v, k: greatest(v, list_element(b.confirmed, k) + list_element(b.locked, k) + {after}))",
        f"'rejected': {plus('rejected', f'list_element(final, j) AND NOT {took}')}",
        "'score': list_element(scores, j)", "'bar': list_element(bars, j)", "'want': list_element(final, j)", f"'alarm': {took}"])
    kept = ", ".join([f"'{f}': b.{f}" for f in ("budget", "cap", "open", "last", "seg", "price", "priced", "last_bin", *_FIELDS)] + ["'score': 0.0::DOUBLE", "'bar': 0.0::DOUBLE", "'want': false", "'alarm': false"])
    item = "entity, n, t, is_row, mi, ms, bins, bin_index, elapsed, risk, utility, seen, given"
    cte(name, f"""/*RECURSIVE*/ SELECT e.entity, 0::BIGINT AS n, 0::BIGINT AS t, 0 AS is_row, 1::BIGINT AS mi, 0::BIGINT AS ms, [{start}] AS st
 FROM (SELECT DISTINCT entity FROM {items}) e, (SELECT max(mi) AS months FROM {items}) m
 UNION ALL SELECT entity, n, t, is_row, mi, ms, CASE WHEN is_row = 1 THEN list_transform(st, lambda b, j: {{{booked}}}) ELSE list_transform(st, lambda b: {{{kept}}}) END
 FROM (SELECT *, list_transform(final, lambda w, j: w AND {room}) AS acc
 FROM (SELECT *, {inherit} AS final
 FROM (SELECT *, list_transform(st, lambda b, j: {wants}) AS wants, list_transform(st, lambda b: {occupied} + {reserve} <= b.cap) AS rooms
 FROM (SELECT *, list_transform(st, lambda b: {score}) AS scores, list_transform(st, lambda b: {bar}) AS bars
 FROM (SELECT {item}, list_transform(st, lambda y: {{{settled}}}) AS st
 FROM (SELECT {item}, list_transform(st, lambda x: {{'b': x.b, 'gone': x.gone, 'c': {counted}}}) AS st
 FROM (SELECT i.*, list_transform(c.st, lambda b: {{'b': b, 'gone': {gone.replace('is_row', 'i.is_row').replace('< t', '< i.t').replace(' t - ', ' i.t - ')}}}) AS st FROM {name} c JOIN {items} i ON i.entity = c.entity AND i.n = c.n + 1)))))))""", items)
    cte(f"{name}_trace", f"""SELECT entity, t, b.budget AS budget, b.score AS score, b.bar AS bar, CAST(b.want AS INT) AS desired, CAST(b.alarm AS INT) AS alarm, b.confirmed[mi] AS confirmed,
 b.pending[mi] AS pending, b.confirmed[mi] + b.pending[mi] + b.locked[mi] AS occupied, b.cap AS capacity FROM (SELECT entity, t, mi, unnest(st) AS b FROM {name} WHERE is_row = 1)""", name)
    cte(f"{name}_months", f"""SELECT z.entity, strftime(make_timestamp(k.ms*1000000), '%Y-%m') AS month, b.budget AS budget, b.cap AS capacity, b.actions[mi] AS actions, b.confirmed[mi] AS confirmed,
 b.pending[mi] AS unsettled, b.released[mi] AS released, b.locked[mi] AS locked, b.peak_pending[mi] AS peak_pending, b.peak_occupied[mi] AS peak_occupied, b.rejected[mi] AS rejected_capacity,
 CAST(b.peak_occupied[mi] <= b.cap AS INT) AS hard_budget_met FROM (SELECT entity, unnest(st) AS b FROM {name} QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC) = 1) z
 JOIN (SELECT DISTINCT entity, mi, ms FROM {items} WHERE is_row = 1) k ON k.entity = z.entity""", f"{name} {items}")
