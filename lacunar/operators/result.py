"""Results, and the errors that callers tell apart."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class InfeasibleError(ValueError):
    """The data of a matrix, group or window don't suffice for the method asked for; callers may skip or fall back."""


@dataclass
class ImputeResult:
    """A completed matrix in feature-vector form and what is to be said about it."""

    df: DataFrame
    method: str
    post_imp: bool = True
    report: dict = field(default_factory=dict)
    status: DataFrame | None = None
    #: (col_idx) of the features that were to be completed; None: all.
    asked: DataFrame | None = None

    def has_remaining_na(self) -> bool:
        """Whether a feature that was to be completed still misses values."""
        asked = self.df if self.asked is None else self.df.join(self.asked, "col_idx", "left_semi")
        return not asked.where(F.exists("vals", lambda v: v.isNull())).isEmpty()

    def fallback(self) -> list:
        """Groups or windows that were skipped or filled with means."""
        return [] if self.status is None else sorted(r[0] for r in self.status.where("status <> 'ok'").select("part").collect())

    def summary(self, n: int = 6) -> str:
        head = [f"Imputed by {self.method}" + ("" if self.post_imp else ", without mean fill")]
        head += [f"{k}: {v}" for k, v in self.report.items()]
        if names := self.fallback():
            shown = ", ".join(map(str, names[:n])) + (f", ... ({len(names)} in all)" if len(names) > n else "")
            head.append(f"Fallback in: {shown}")
        if self.has_remaining_na():
            head.append("Missing values remain")
        rows = self.df.orderBy("col_idx").limit(n).collect()
        return "\n".join(head + [f"{r['feature']}: {r['vals'][:n]}" for r in rows])


def show_table(table: DataFrame, n: int = 10) -> str:
    """The first n rows of a group, window or tuning table as text, lists by their length."""
    rows = table.limit(n + 1).collect()
    short = lambda v: f"<{len(v)}>" if isinstance(v, list) else str(v)
    lines = ["  ".join(table.columns), *("  ".join(short(v) for v in r) for r in rows[:n])]
    return "\n".join(lines + (["..."] if len(rows) > n else []))
