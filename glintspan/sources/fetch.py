"""What a study fetches: participant ids, default ranges, levels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default ranges of a fetch. First and last trial, configuration and block, and the epochs.
TRIALS, CONFIGURATIONS, BLOCKS, EPOCHS = (0, 17), (0, 99), (1, 3), ("na", "view")
#: Levels that can be fetched, and their tables.
LEVELS = {"timepoint": "timepoint_viewing", "fix_sacc": "fixations", "viewing": "viewing", "trial": "trial"}


def as_list(value: Any, kind: type | tuple[type, ...]) -> list:
    """A value of `kind` as a list of one, a list or tuple of such as a list; anything else is an error."""
    if isinstance(value, kind):
        return [value]
    if isinstance(value, (list, tuple)) and all(isinstance(x, kind) for x in value):
        return list(value)
    raise TypeError(f"{value!r} is neither {kind} nor a list of it")


def study_ids(ids: str | int | Sequence[str | int], study: str) -> list[str] | None:
    """Participant ids with their study's prefix, given with or without it; None, no filter, for "all"."""
    if ids == "all":
        return None
    return [x if x.startswith(f"{study}_") else f"{study}_{x}" for x in map(str, as_list(ids, (str, int)))]


def between(c: str, limits: tuple[int, int]) -> Column:
    return F.col(c).between(*limits)


def fetched(df: DataFrame, *, ids: Sequence[str] | None = None, pid: str = "ppt_id", epoch: str | None = None, epochs: Sequence[str] = EPOCHS, trial: str | None = None, trials: tuple[int, int] = TRIALS, configuration: str | None = None, configurations: tuple[int, int] = CONFIGURATIONS, block: str | None = None, blocks: tuple[int, int] = BLOCKS, practice: str | None = None) -> DataFrame:
    """The rows that a fetch returns by default: of the given ids, epochs and ranges, without practice. Only columns that are named are filtered, all by one predicate that reaches the scan."""
    keep = F.lit(True)
    if ids is not None:
        keep = keep & F.col(pid).isin(*ids)
    if epoch:
        keep = keep & F.col(epoch).isin(*epochs)
    for c, limits in ((trial, trials), (configuration, configurations), (block, blocks)):
        if c:
            keep = keep & between(c, limits)
    if practice:
        keep = keep & ~F.coalesce(F.col(practice), F.lit(False))
    return df.where(keep)


def drop_like(df: DataFrame, *parts: str) -> DataFrame:
    """`df` without the columns whose names hold one of `parts`."""
    return df.drop(*[c for c in df.columns if any(p in c for p in parts)])


def level(name: str, read: Callable[[str], DataFrame], **filters) -> DataFrame:
    """The table of a level, by a reader of tables, with the default filters; an unknown level is an error."""
    if name not in LEVELS:
        raise KeyError(f"{name} is none of {', '.join(LEVELS)}")
    return fetched(read(LEVELS[name]), **filters)


def groups_by_label(people: DataFrame, pid: str, label: str, *, valid: Column | None = None) -> DataFrame:
    """(pid, group): Younger, Older, MCI+, MCI- or MCIu by the label (Y, O, MCI+, MCI-, and P or MCI); others, and rows that aren't valid, go."""
    names = F.create_map(*[F.lit(x) for pair in (("Y", "Younger"), ("O", "Older"), ("MCI+", "MCI+"), ("MCI-", "MCI-"), ("P", "MCIu"), ("MCI", "MCIu")) for x in pair])
    rows = people.where(valid) if valid is not None else people
    return rows.select(pid, F.try_element_at(names, F.col(label)).alias("group")).where("group is not null")
