"""A library of members over tables: what is known of them, what recurs among them, its exact bounds, and what else is like it.

Each method is a plan over the tables given; nothing is held on the driver but ids of reference members.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from waveloom.operators import consensus as C
from waveloom.operators import refine as R
from waveloom.operators import segments as S
from waveloom.plans.shared import stored


@dataclass(frozen=True)
class Library:
    """landmarks: hash, doc_id, t, r; frames: id, t, v and feature columns; seconds: id, duration; lengths: doc_id, n.
    near: makes the frames of a table of windows (id, lo, hi) instead, where those of all members would be too many; a member has ``n`` of them."""

    landmarks: DataFrame | None
    lengths: DataFrame
    frames: DataFrame | None = None
    seconds: DataFrame | None = None
    near: Callable[[DataFrame], DataFrame] | None = None

    def add(self, other: Library) -> Library:
        """The members of both."""
        both = lambda a, b: a if b is None else b if a is None else a.unionByName(b)
        return replace(self, landmarks=both(self.landmarks, other.landmarks), lengths=both(self.lengths, other.lengths), frames=both(self.frames, other.frames), seconds=both(self.seconds, other.seconds))

    def members(self, hint: list[int] | None = None) -> tuple[DataFrame, list[int]]:
        """Passages by reference and member, present or absent, and the references."""
        held = stored(C.recurring(self.landmarks), "landmarks")
        refs = C.references(held, hint=hint)
        bins = stored(C.votes_of(held, refs), "votes")
        peaks = C.merged(bins, C.suppressed(C.top_peaks(C.peaks(C.offset_votes(bins)))))
        return stored(C.members(stored(peaks, "peaks")), "members"), refs

    def discover(self, by: str = "support", most: int | None = None, hint: list[int] | None = None) -> DataFrame:
        """Ranked passages of the reference that explains most."""
        found, refs = self.members(hint)
        return C.ranked_assets(C.best_reference(stored(C.assets(found, self.lengths, self.lengths.count()), "assets"), refs), by, most)

    def refine(self, reference, estimates: DataFrame, a: int, b: int, rule: R.Rule = R.Rule()) -> DataFrame:
        """Exact bounds of frames a to b of one member in the others (estimates: id, at, until, present)."""
        if self.near is not None:
            n = self.lengths.filter(self.lengths["doc_id"] == reference).agg({"n": "sum"}).first()[0]
            window = estimates.sparkSession.createDataFrame([(reference, max(0, a - rule.pad), b + rule.pad)], "id long, lo long, hi long")
            return R.refined(stored(self.near(window), "reference"), lambda windows: self.near(windows.filter(windows["id"] != reference)), estimates, a, b, n, rule=rule)
        own, others = self.frames.filter(self.frames["id"] == reference), self.frames.filter(self.frames["id"] != reference)
        return R.refined(own, others, estimates, a, b, own.count(), rule=rule)

    def pinpoint(self, rule: R.Rule = R.Rule(), by: str = "support", hint: list[int] | None = None) -> DataFrame | None:
        """Discovery and refinement in one: the first passage's exact bounds in every member that may hold it, its reference's own under
        the reference's id; None where nothing recurs. frames has the members' ids and counts as landmarks do."""
        return self.pinpoint_of(*self.members(hint), rule, by)

    def pinpoint_of(self, found: DataFrame, refs: list[int], rule: R.Rule = R.Rule(), by: str = "support") -> DataFrame | None:
        """The same of members that are known already (a stored table, as ``members`` gives it) and their references."""
        best = C.best_reference(stored(C.assets(found, self.lengths, self.lengths.count()), "assets"), refs)
        first = C.ranked_assets(best, by, 1).select("a", "asset", "ref_from", "ref_to").first()  # one row
        if first is None:
            return None
        own = found.filter((found["a"] == first["a"]) & (found["asset"] == first["asset"]))
        estimates = own.filter("NOT is_reference").select(own["doc_id"].alias("id"), own["start"].alias("at"), own["end"].alias("until"), "present")
        bounds = self.refine(first["a"], stored(estimates, "estimates"), first["ref_from"], first["ref_to"], rule)
        return bounds.na.fill({"id": first["a"]})

    def ranges(self, exemplars: DataFrame, **options) -> DataFrame:
        """Segments like the exemplars (id, s, e), a row with the error where a member can't be calibrated."""
        return S.ranges_for(self.frames, exemplars, self.seconds, **options)
