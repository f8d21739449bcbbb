"""Appending to stored tables: match, align, leave out what is there, and keep roles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions.roles import RoleMap
from casemill.plans.lineage import stored
from casemill.sources.tables import clean_name

LEAST_LIKENESS = 0.8


def match_table(name: str, columns: list[str], stored: dict[str, list[str]], least: float = LEAST_LIKENESS) -> str | None:
    """The stored table of the same name, or the first of those whose columns are most alike (Jaccard)."""
    if name in stored:
        return name
    own, best = {clean_name(c) for c in columns}, (0.0, None)
    for table, cols in stored.items():
        other = {clean_name(c) for c in cols}
        likeness = len(own & other) / max(1, len(own | other))
        if likeness >= least and likeness > best[0]:
            best = (likeness, table)
    return best[1]


def align(incoming: DataFrame, stored: DataFrame) -> tuple[DataFrame, int]:
    """The incoming rows in the stored schema (missing columns are null), and how many columns were left out."""
    by = {clean_name(c): c for c in incoming.columns}
    cols = [(F.col(f"`{by[clean_name(f.name)]}`").try_cast(f.dataType) if clean_name(f.name) in by else F.lit(None).cast(f.dataType)).alias(f.name) for f in stored.schema.fields]
    known = {clean_name(c) for c in stored.columns}
    return incoming.select(*cols), sum(n not in known for n in by)


def new_by_id(incoming: DataFrame, stored: DataFrame, id_col: str) -> DataFrame:
    """Incoming rows whose id isn't stored; null ids and repetitions among the incoming rows stay."""
    return incoming.join(stored.select(F.col(id_col).alias("__id")), incoming[id_col] == F.col("__id"), "left_anti")


def new_by_row(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows that aren't stored as a whole; nulls are equal."""
    known = stored.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(incoming.columns)])
    same = F.lit(True)
    for i, c in enumerate(incoming.columns):
        same = same & incoming[c].eqNullSafe(F.col(f"__{i}"))
    return incoming.join(known, same, "left_anti")


@dataclass
class Appended:
    table: DataFrame
    added: int
    duplicates_skipped: int
    extras_ignored: int
    new_table: bool
    profile: DataFrame | None = None
    state: DataFrame | None = None


def reprofile(table: DataFrame, name: str, roles: RoleMap | None = None) -> DataFrame:
    """A profile of a table's columns as they are now; columns that had a role keep it."""
    from casemill.operators.profile import column_stats

    return _with_roles(column_stats(table, name), roles)


def _with_roles(stats: DataFrame, roles: RoleMap | None) -> DataFrame:
    from casemill.operators.profile import infer_roles

    fresh = infer_roles(stats)
    kept = F.create_map(*[F.lit(x) for pair in roles.columns.items() for x in pair]) if roles and roles.columns else F.lit(None).cast("map<string,string>")
    return fresh.withColumn("role", F.coalesce(F.try_element_at(kept, F.col("column")), "role"))


def append(incoming: DataFrame, stored: DataFrame | None, roles: RoleMap | None = None, read_only: bool = False, name: str = "table") -> Appended:
    """The stored table and the incoming rows that it lacks, with a fresh profile; roles (if given) name the id and stay."""
    if read_only:
        raise PermissionError("the data set is read-only")
    if stored is None:
        return Appended(incoming, incoming.count(), 0, 0, True, reprofile(incoming, name))
    rows, extras = align(incoming, stored)
    key = roles.first("id") if roles else None
    new = new_by_id(rows, stored, key) if key in stored.columns else new_by_row(rows, stored)
    n, added = rows.count(), new.count()
    table = stored.unionByName(new)
    return Appended(table, added, n - added, extras, False, reprofile(table, name, roles))


def append_to_state(incoming: DataFrame, schema: DataFrame, state: DataFrame, index: str, id_col: str, roles: RoleMap | None = None, name: str = "table") -> Appended:
    """The incoming rows that the id index lacks, the merged profile state, and the profile from it.

    Nothing that is stored is read but the state and the index; schema gives the stored table's columns. The caller writes
    the rows and the state, and adds the ids to the index.
    """
    from casemill.operators import states

    rows, extras = align(incoming, schema)
    new = stored(states.new_ids(rows, id_col, index), "new-rows")
    merged = stored(states.merge_states(state, states.profile_state(new, name)), "state")
    n, added = rows.count(), new.count()
    return Appended(new, added, n - added, extras, False, _with_roles(states.stats_of(merged), roles), merged)


def link_new_table(profile: DataFrame, table: str) -> DataFrame:
    """Relations between a new table and the others, without a change of the others' roles."""
    from casemill.operators.profile import relations

    return relations(profile).filter((F.col("from_table") == table) | (F.col("to_table") == table))
