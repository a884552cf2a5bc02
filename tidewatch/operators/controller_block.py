"""The reserved-capacity controller for many entities side by side.

Takes the decisions of :class:`tidewatch.operators.controller.EntityController`, with arrays over (entity, budget) in place of
accounts and over (month, entity, budget) in place of ledgers.  Step k decides the k-th rows of all entities of a block, longest panels
first, so that those with rows left are always the front of the arrays.  Open reservations lie in a ring as long as a horizon has rows.
"""

from __future__ import annotations

import copy
import math

import numpy as np

#: Ledger fields that count something.
COUNTS = ("confirmed", "pending", "locked", "released", "actions", "peak_pending", "peak_occupied", "peak_unlocked", "rejected_capacity", "rejected_pacing")
NEVER = np.iinfo(np.int64).min


class Panel:
    """Rows of a block of whole entities, in order of (entity, t), and what falls between them."""

    def __init__(self, columns: dict[str, np.ndarray], starts: np.ndarray, onsets: list[np.ndarray], horizon: int):
        lengths = np.diff(np.append(starts, len(columns["t"])))
        self.order = np.argsort(-lengths, kind="stable")
        self.columns, self.starts, self.lengths = columns, starts[self.order], lengths[self.order]
        t = columns["t"]
        # Rows of the entity that have matured at each row.
        self.mature = np.empty(len(t), dtype=np.int64)
        held, found = 1, []
        for place, (start, n) in enumerate(zip(self.starts, self.lengths)):
            mine = t[start : start + n]
            gone = np.searchsorted(mine, mine - horizon, side="right")
            self.mature[start : start + n] = gone
            held = max(held, int((np.arange(n) - np.append(0, gone[:-1])).max()) + 1)
            known = np.sort(onsets[self.order[place]])
            at = np.searchsorted(mine, known, side="left")
            inside = at < n  # later onsets come after the entity's last row
            at, known = at[inside], known[inside]
            turn = np.arange(len(at)) - np.searchsorted(at, at, side="left")
            found.append((at, turn, np.full(len(at), place), known))
        self.ring = held
        step, turn, place, known = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
        by = np.lexsort((place, turn, step))
        step, turn, place, known = step[by], turn[by], place[by], known[by]
        # Onsets by the step they come before; those of one entity at one step take turns.
        self.events: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        cuts = np.flatnonzero((np.diff(step) != 0) | (np.diff(turn) != 0)) + 1
        for piece in np.split(np.arange(len(step)), cuts) if len(step) else []:
            self.events.setdefault(int(step[piece[0]]), []).append((place[piece], known[piece]))

    def beside(self, columns: dict[str, np.ndarray]) -> Panel:
        """The same rows with other columns."""
        other = copy.copy(self)
        other.columns = columns
        return other


class Block:
    """All accounts of a panel's entities under one rule set."""

    def __init__(self, rules, capacities: list[int], panel: Panel, months: int):
        self.rules, self.panel = rules, panel
        self.capacity = np.array(capacities, dtype=np.int64)
        n, b, w = len(panel.starts), len(capacities), panel.ring
        self.entities = n
        self.ledger = {name: np.zeros((months * n, b), dtype=np.int64) for name in COUNTS}
        self.bins = np.zeros(months * n, dtype=np.int64)
        self.known = np.zeros(months * n, dtype=bool)
        self.price = np.full((months * n, b), float(rules.dual_initial_price))
        self.last_bin = np.full((months * n, b), -1, dtype=np.int64)
        self.last_action = np.full((n, b), NEVER, dtype=np.int64)
        self.segment = np.zeros((n, b), dtype=np.int64)
        self.open = np.zeros((n, b, w), dtype=bool)
        self.of_segment = np.zeros((n, b, w), dtype=np.int64)
        self.issue = np.full((n, w), NEVER, dtype=np.int64)
        self.month = np.zeros((n, w), dtype=np.int64)
        self.seen = np.zeros((n, w), dtype=bool)

    def _note_peak(self, rows: np.ndarray) -> None:
        x = self.ledger
        pending = x["pending"][rows]
        used = x["confirmed"][rows] + pending
        for name, value in (("peak_pending", pending), ("peak_unlocked", used), ("peak_occupied", used + x["locked"][rows])):
            x[name][rows] = np.maximum(x[name][rows], value)

    def _event(self, who: np.ndarray, onset: np.ndarray) -> None:
        """An onset frees the earliest segment that foresaw it, once per budget."""
        self.last_action[who] = NEVER
        issue = self.issue[who]
        inside = (issue >= (onset - self.rules.horizon)[:, None]) & (issue < onset[:, None])
        foresaw = self.open[who] & inside[:, None, :]
        segment = self.of_segment[who]
        winner = np.where(foresaw, segment, np.iinfo(np.int64).max).min(axis=2)
        freed = foresaw & (segment == winner[:, :, None])
        if not freed.any():
            return
        self.open[who] &= ~freed
        months = self.month[who]
        for month in np.unique(months[freed.any(axis=1)]):
            times = (freed & (months == month)[:, None, :]).sum(axis=2)
            rows = month * self.entities + who
            self.ledger["pending"][rows] -= times * int(self.rules.reserve)
            self.ledger["released" if self.rules.release else "locked"][rows] += times
            self._note_peak(rows)

    def _mature(self, before: np.ndarray, now: np.ndarray) -> None:
        """Reservations whose horizon has passed leave the ring; observed ones become false bins."""
        x = self.ledger
        for ahead in range(int((now - before).max(initial=0))):
            who = np.flatnonzero(before + ahead < now)
            slot = (before[who] + ahead) % self.panel.ring
            due = self.open[who, :, slot]
            settled = due & self.seen[who, slot][:, None]
            self.open[who, :, slot] = False
            if settled.any():
                rows = self.month[who, slot] * self.entities + who
                x["pending"][rows] -= settled * int(self.rules.reserve)
                x["confirmed"][rows] += settled
                self._note_peak(rows)

    def _dual(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = np.maximum(self.bins[rows], 1)[:, None]
        return self.capacity / bins, self.rules.dual_step_scale / np.sqrt(bins)

    def _judge(self, rows: np.ndarray, row: dict[str, np.ndarray], occupied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, shape = self.rules, occupied.shape
        utility, elapsed = row["utility"][:, None], row["elapsed"][:, None]
        if r.method == "dual_mirror_descent":
            idle = row["bin_index"][:, None] - self.last_bin[rows] - 1
            rate, eta = self._dual(rows)
            price = self.price[rows]
            price = self.price[rows] = np.where(idle > 0, np.maximum(0.0, price - eta * rate * idle), price)
            score = np.minimum(np.maximum(utility / (r.step_minutes * r.horizon_steps / 60.0), 0.0), 1.0)
            return np.broadcast_to(score, shape), price, score > price
        if r.method == "switch_over":
            bar = np.where(elapsed < r.switch_fraction, r.switch_high, r.switch_low)
            return np.broadcast_to(utility, shape), np.broadcast_to(bar, shape), np.broadcast_to(utility >= bar, shape)
        score = utility if r.use_lead_utility else row["risk"][:, None]
        bar = np.full(shape, float(r.score_threshold))
        if r.use_price:
            share = 1.0 / np.maximum(self.capacity, 1)
            drift = occupied * share - (elapsed if r.use_remaining_time else 0.5)
            push = r.price_initial + r.price_rate * drift + r.pending_pressure * self.ledger["pending"][rows] * share
            factor = np.fromiter(map(math.exp, np.minimum(np.maximum(push, -12.0), 12.0).ravel().tolist()), dtype=float, count=push.size)
            bar = np.where(self.capacity > 0, bar * factor.reshape(shape), bar)
        return np.broadcast_to(score, shape), bar, score >= bar

    def _decide(self, n: int, k: int, row: dict[str, np.ndarray], given: list[np.ndarray | None] | None) -> tuple[np.ndarray, ...]:
        r, x, who = self.rules, self.ledger, np.arange(n)
        rows = row["month"] * self.entities + who
        new = rows[~self.known[rows]]
        if len(new):
            self.bins[new] = row["month_bins"][~self.known[rows]]
            self.known[new] = True
        occupied = x["confirmed"][rows] + x["pending"][rows] + x["locked"][rows]
        score, bar, wants = self._judge(rows, row, occupied)
        wants, now, last = wants.copy(), row["t"][:, None], self.last_action[:n]
        for i, mask in enumerate(given or ()):
            if mask is not None:
                wants[:, i] = mask
        fresh = last == NEVER
        gap = now - np.where(fresh, now, last)
        if r.dedup_bins:
            wants &= fresh | (gap >= r.dedup_bins * r.step)
        if r.method == "uniform_pacing":
            allowed = np.minimum(self.capacity, np.floor(row["elapsed"][:, None] * self.capacity).astype(np.int64) + r.pacing_slack)
            late = wants & (occupied + 1 > allowed)
            x["rejected_pacing"][rows] += late
            wants &= ~late
        rooms = occupied + int(r.reserve) <= self.capacity
        if r.couple:
            # Larger budgets inherit smaller ones' wishes; a wish needs room in every budget above it.
            wants = np.logical_or.accumulate(wants, axis=1)
            rooms = np.logical_and.accumulate(rooms[:, ::-1], axis=1)[:, ::-1]
        accepted = wants & rooms
        slot = k % self.panel.ring
        self.issue[:n, slot], self.month[:n, slot], self.seen[:n, slot] = row["t"], row["month"], row["seen"]
        self.open[:n, :, slot] = accepted
        if accepted.any():
            x["actions"][rows] += accepted
            self.segment[:n] += accepted & (fresh | (gap > r.step))
            self.last_action[:n] = np.where(accepted, now, last)
            self.of_segment[:n, :, slot] = self.segment[:n]
            x["pending"][rows] += accepted * int(r.reserve)
            self._note_peak(rows)
            if r.reserve and (x["peak_occupied"][rows] > self.capacity).any() and (
                    accepted & (x["confirmed"][rows] + x["pending"][rows] + x["locked"][rows] > self.capacity)).any():
                raise RuntimeError("hard budget exceeded")
        x["rejected_capacity"][rows] += wants & ~accepted
        if r.method == "dual_mirror_descent":
            rate, eta = self._dual(rows)
            self.price[rows] = np.maximum(0.0, self.price[rows] + eta * (wants.astype(float) - rate))
            self.last_bin[rows] = row["bin_index"][:, None]
        confirmed, pending = x["confirmed"][rows], x["pending"][rows]
        return score, bar, wants, accepted, confirmed, pending, confirmed + pending + x["locked"][rows], self.price[rows]

    def run(self, given: list[np.ndarray | None] | None, traced: bool) -> dict[str, np.ndarray]:
        """Steps the panel through; returns the decisions, by row and budget, if they are ``traced``."""
        panel, b = self.panel, len(self.capacity)
        kinds = dict(score=float, bar=float, desired=np.int64, alarm=np.int64, confirmed=np.int64, pending=np.int64, occupied=np.int64, price=float)
        out = {c: np.empty((len(panel.columns["t"]), b), dtype=kind) for c, kind in kinds.items()} if traced else {}
        before = np.zeros(self.entities, dtype=np.int64)
        n = self.entities
        for k in range(int(panel.lengths[0])):
            while panel.lengths[n - 1] <= k:
                n -= 1
            for who, onset in panel.events.get(k, ()):
                self._event(who, onset)
            at = panel.starts[:n] + k
            row = {c: v[at] for c, v in panel.columns.items()}
            now = panel.mature[at]
            self._mature(before[:n], now)
            before[:n] = now
            made = self._decide(n, k, row, None if given is None else [None if m is None else m[at] for m in given])
            for name, value in zip(out, made):
                out[name][at] = value
        return out
