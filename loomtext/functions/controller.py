"""The controller of chunk sizes: one event after another moves its target, and tells when a run should end."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rules:
    """Bounds of the target; successes that grow it; the latency whose 95th percentile shrinks it; the first events of a run, in which a
    shrink asks for a new plan (``canary``, 0 for none); timeouts in a row that stop a run (0 for none)."""

    start: int = 1000
    least: int = 200
    most: int = 2000
    window: int = 20
    threshold_ms: int = 45_000
    reduce: float = 0.25
    increase: float = 0.1
    canary: int = 0
    stop_after_timeouts: int = 0


@dataclass
class Run:
    """What is known of a run: its target, successes in a row, events, timeouts in a row, how it ended, and its last latencies."""

    target: int
    good: int = 0
    seen: int = 0
    timeouts: int = 0
    ended: str = ""
    last: list[int] = field(default_factory=list)

    def step(self, rules: Rules, success: bool | None, timeout: bool | None, latency_ms: int | None) -> str:
        """Take one event in; returns what it did: shrink, increase, steady (the target is at its bound), observe, or nothing."""
        event, was = "", self.target
        shrunk = min(was, max(rules.least, math.floor(was * (1 - rules.reduce))))
        self.seen += 1
        if success:
            self.good, self.timeouts = self.good + 1, 0
            if latency_ms is not None and latency_ms > 0:
                self.last = [*self.last, latency_ms][-rules.window :]
            if self.last and sorted(self.last)[max(1, math.ceil(len(self.last) * 0.95)) - 1] > rules.threshold_ms:
                self.target, event = shrunk, "shrink"
            elif self.good >= rules.window:
                self.target, event = max(was, min(rules.most, math.ceil(was * (1 + rules.increase)))), "increase"
            self.good = 0 if event else self.good
        else:
            self.good, event = 0, "observe"
            self.timeouts = self.timeouts + 1 if timeout else 0
            if timeout:
                self.target, event = shrunk, "shrink"
        if event in ("shrink", "increase") and self.target == was:
            event = "steady"
        if not self.ended:
            early = event == "shrink" and self.seen <= rules.canary
            broken = 0 < rules.stop_after_timeouts <= self.timeouts
            self.ended = "replan" if early else "stopped" if broken else ""
        return event
