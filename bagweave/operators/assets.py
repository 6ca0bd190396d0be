"""Member assets and catalogs: sidecars bound to their parent, resumption, populations, views, mappings and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagweave.functions.ranged import dealt
from bagweave.functions.scalar import ratio


def bound_sidecar(base: DataFrame, sidecar: DataFrame, key: str, digest: str, family: str) -> DataFrame:
    """The base with the sidecar's columns as family_column where the sidecar names the base's digest; state is bound, stale or absent."""
    values = [c for c in sidecar.columns if c not in (key, digest)]
    side = sidecar.select(F.col(key).alias("side_key"), F.col(digest).alias("side_digest"), *(F.col(c).alias(f"{family}_{c}") for c in values))
    j = base.join(side, F.col(key) == F.col("side_key"), "left")
    same = F.col("side_digest") == F.col(digest)
    state = F.when(F.col("side_key").isNull(), "absent").when(same, "bound").otherwise("stale")
    return j.select(*base.columns, *(F.when(same, F.col(f"{family}_{c}")).alias(f"{family}_{c}") for c in values), state.alias(f"{family}_state"))


def pending_assets(members: DataFrame, families: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """(key, family, stage) that no finished record of the same parameters and parent covers; a family waits for those its stage needs.

    families: family, stage, parameters; done: key, family, parameters, parent. ``ready`` is true if the family of the stage before is done.
    """
    wanted = members.select(key, "parent").crossJoin(F.broadcast(families))  # families are a fixed list of names
    left = wanted.join(done, [key, "family", "parameters", "parent"], "left_anti")
    finished = done.join(F.broadcast(families), ["family", "parameters"]).join(members.select(key, "parent"), [key, "parent"]).select(key, (F.col("stage") + 1).alias("stage"), F.lit(True).alias("ready")).distinct()
    return left.join(finished, [key, "stage"], "left").select(key, "family", "stage", (F.coalesce("ready", F.lit(False)) | (F.col("stage") == 0)).alias("ready"))


def digest_mismatches(expected: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """Members whose checksum differs or that one side lacks: key, fault."""
    e, f = expected.select(F.col(key), F.col(digest).alias("e")), found.select(F.col(key), F.col(digest).alias("f"))
    j = e.join(f, key, "full")
    fault = F.when(F.col("e").isNull(), "unexpected").when(F.col("f").isNull(), "missing").when(F.col("e") != F.col("f"), "changed")
    return j.select(key, fault.alias("fault")).filter("fault is not null")


def population_differences(fitted: DataFrame, published: DataFrame, view: str, key: str, digest: str) -> DataFrame:
    """Views whose fitted sources are not exactly the published training members: view, missing, foreign, changed, equal."""
    f = fitted.select(view, key, F.col(digest).alias("f"), F.lit(True).alias("in_fit"))
    p = published.select(view, key, F.col(digest).alias("p"), F.lit(True).alias("in_view"))
    j = f.join(p, [view, key], "full").groupBy(view).agg(F.count_if(F.col("in_fit").isNull()).alias("missing"), F.count_if(F.col("in_view").isNull()).alias("foreign"), F.count_if(F.col("f") != F.col("p")).alias("changed"))
    return j.withColumn("equal", F.col("missing") + F.col("foreign") + F.col("changed") == 0)


def view_moments(df: DataFrame, views: str, value: str) -> DataFrame:
    """Moments of a feature in every published training view that a member is in (an array), and in full."""
    rows = df.select(F.explode(F.concat(F.array(F.lit("full")), F.coalesce(F.col(views), F.array().cast("array<string>")))).alias("view"), value)
    return rows.groupBy("view").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def dilution_audit(members: DataFrame, views: DataFrame, key: str, group: str, split: str) -> DataFrame:
    """Nested training views (view, level, key) against the members: unknown ids, ids outside train, ids of the level below that are gone, groups held in part."""
    known = views.join(members.select(key, group, split), key, "left")
    base = known.groupBy("view", "level").agg(F.count("*").alias("size"), F.count_if(F.col(split).isNull()).alias("unknown"), F.count_if(F.col(split) != "train").alias("non_train"))
    up = views.select("view", (F.col("level") + 1).alias("level"), key)
    levels = views.select("view", "level").distinct()
    lost = up.join(levels, ["view", "level"]).join(views, ["view", "level", key], "left_anti").groupBy("view", "level").agg(F.count("*").alias("lost"))
    sizes = members.filter(F.col(split) == "train").groupBy(group).agg(F.count("*").alias("whole"))
    held = known.filter(F.col(split) == "train").groupBy("view", "level", group).agg(F.count("*").alias("held")).join(sizes, group)
    parts = held.groupBy("view", "level").agg(F.count_if(F.col("held") < F.col("whole")).alias("fragmented"), F.count("*").alias("groups"))
    out = base.join(lost, ["view", "level"], "left").join(parts, ["view", "level"], "left")
    return out.select("view", "level", "size", "unknown", "non_train", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("lost", "fragmented", "groups")))


def snapshot_index(rows: DataFrame, key: str, content: str) -> DataFrame:
    """One entry a key: bytes and SHA-256 of the content, how many sources agree; keys with differing contents are conflicts."""
    marks = rows.select(key, F.sha2(content, 256).alias("digest"), F.octet_length(content).alias("bytes"))
    a = marks.groupBy(key).agg(F.count("*").alias("sources"), F.min("digest").alias("digest"), F.max("digest").alias("other"), F.min("bytes").alias("bytes"))
    return a.select(key, "sources", F.when(F.col("digest") == F.col("other"), F.col("digest")).alias("digest"), "bytes", (F.col("digest") != F.col("other")).alias("conflict"))


def wanted_hits(database: DataFrame, wanted: DataFrame, sequence: str, key: str, kind: Column) -> DataFrame:
    """Entries of the database, of the kind, whose normalized sequence is wanted: sequence digest, hits, first and last key.

    Sequences are compared by SHA-256 of their normal form, so long ones aren't dealt; the digests of both sides are.
    """
    normal = lambda c: F.sha2(F.translate(F.regexp_replace(c, r"[\s*]", ""), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 256)
    w = wanted.select(normal(F.col(sequence)).alias("digest")).distinct()
    hits = database.filter(kind).select(key, normal(F.col(sequence)).alias("digest"))
    return hits.join(w, "digest", "left_semi").groupBy("digest").agg(F.countDistinct(key).alias("hits"), F.min(key).alias("first"), F.max(key).alias("last"))


def reduced_sites(atoms: DataFrame, site: list[str], place: str, occupancy: str, alternative: str) -> DataFrame:
    """Of each place's alternatives the one of the highest occupancy (ties: the lower label)."""
    w = Window.partitionBy(*site, place).orderBy(F.desc(occupancy), alternative)
    return atoms.withColumn("alt_rank", F.row_number().over(w)).filter("alt_rank = 1").drop("alt_rank")


def centred(atoms: DataFrame, by: list[str], axes: tuple[str, ...]) -> DataFrame:
    """Coordinates about the mean of their owner; means are partial aggregates joined back."""
    means = atoms.groupBy(*by).agg(*(F.avg(c).alias(f"{c}_mean") for c in axes))
    return atoms.join(means, by).withColumns({c: F.col(c) - F.col(f"{c}_mean") for c in axes}).drop(*(f"{c}_mean" for c in axes))


def assembly_summary(copies: DataFrame, partners: DataFrame, assembly: str, copy: str, site: str, residue: str, donors: int = 3, residues: int = 2) -> DataFrame:
    """For every copy of an assembly, also those without any: accepted sites and their donors. A site is accepted for a copy with enough donor atoms on enough residues."""
    local = partners.groupBy(assembly, copy, site).agg(F.count("*").alias("n"), F.countDistinct(residue).alias("r")).filter((F.col("n") >= donors) & (F.col("r") >= residues))
    a = local.groupBy(assembly, copy).agg(F.count("*").alias("accepted_sites"), F.sum("n").alias("donor_count"))
    return copies.join(a, [assembly, copy], "left").select(assembly, copy, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("accepted_sites", "donor_count")))


def sensitivity_grid(pairs: DataFrame, by: list[str], distance: str, occupancy: str, cutoffs: list[float], least: list[float], donors: int) -> DataFrame:
    """Owners with at least ``donors`` partners at every pair of a distance cutoff and a least occupancy (a fixed grid)."""
    grid = F.explode(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.lit(o).alias("least")) for c in cutoffs for o in least)))
    hits = pairs.withColumn("g", grid).filter((F.col(distance) <= F.col("g.cutoff")) & (F.col(occupancy) >= F.col("g.least")))
    sites = hits.groupBy("g.cutoff", "g.least", *by).agg(F.count("*").alias("n"))
    return sites.groupBy("cutoff", "least").agg(F.count_if(F.col("n") >= donors).alias("sites"), F.sum("n").alias("partners"))


def metal_targets(gaps: DataFrame, donor: str, centre: str, near: float, far: float, levels: list[float]) -> DataFrame:
    """Hard and soft targets of points from their least gap to a donor or metal centre: 1 up to near, 0 from far on, undecided between; and the share of levels that call it positive."""
    gap = F.least(F.col(donor), F.col(centre))  # skips nulls
    hard = F.when(gap.isNull() | (gap >= far), 0).when(gap <= near, 1)
    soft = F.when(gap.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (far - gap) / (far - near))))
    share = F.when(gap.isNull(), 0.0).otherwise(sum((gap <= x).cast("double") for x in levels) / len(levels))
    return gaps.withColumns({"gap": gap, "hard": hard, "soft": soft, "valid": hard.isNotNull(), "sensitivity": share})


def site_differences(observed: DataFrame, expected: DataFrame, key: list[str], fields: list[str], derived: list[str]) -> DataFrame:
    """Sites that differ: of schema 2.0 in any field, of older schemas in the fields they had (derived ones are new); sites of one side alone too."""
    o = observed.select(*key, *(F.col(c).alias(f"o_{c}") for c in fields + derived), F.lit(True).alias("seen"))
    j = expected.join(o, key, "full")
    differ = lambda c: ~F.col(c).eqNullSafe(F.col(f"o_{c}"))
    old = F.greatest(*(differ(c) for c in fields))
    new = F.greatest(old, *(differ(c) for c in derived))
    fault = F.when(F.col("schema").isNull(), "unexpected").when(F.col("seen").isNull(), "missing").when(F.when(F.col("schema") == "2.0", new).otherwise(old), "differs")
    return j.select(*key, fault.alias("fault")).filter("fault is not null")


def mapped_subjects(subjects: DataFrame, chains: DataFrame, subject: str, chain: str, sequence: str) -> DataFrame:
    """Subjects to chains by exact sequence: status mapped (one chain), ambiguous (several), unmatched, empty; the least chain."""
    c = chains.filter(F.length(sequence) > 0).groupBy(sequence).agg(F.min(chain).alias("chain"), F.countDistinct(chain).alias("chains"))
    j = subjects.join(c, sequence, "left")
    status = F.when(F.coalesce(F.length(sequence), F.lit(0)) == 0, "empty").when(F.col("chains").isNull(), "unmatched").when(F.col("chains") > 1, "ambiguous").otherwise("mapped")
    return j.select(subject, status.alias("status"), F.when(status.isin("mapped", "ambiguous"), F.col("chain")).alias("chain"))


def core_decisions(df: DataFrame, key: str) -> DataFrame:
    """Accept or reject by the first reason that holds, from the candidates' flags (label, contacts, errors, candidates)."""
    positive = F.col("label") == 1
    reason = (
        F.when(~positive & (F.col("contacts") > 0), "negative_label_conflict").when(~positive & (F.col("errors") > 0), "negative_incomplete_audit").when(~positive & (F.col("candidates") == 0), "negative_without_structure")
        .when(positive & (F.col("contacts") > 0), "accepted_positive").when(positive & (F.col("errors") > 0), "positive_incomplete_audit").when(positive, "positive_without_contact").otherwise("accepted_negative")
    )
    return df.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason").startswith("accepted"), "accepted").otherwise("rejected")).select(key, "decision", "reason")


def contradictory(df: DataFrame, sequence: str, label: str) -> DataFrame:
    """Adds eligible: false for every row of a sequence that has both labels."""
    s = df.groupBy(sequence).agg((F.min(label) != F.max(label)).alias("contradicted"))
    return df.join(s, sequence).withColumn("eligible", ~F.col("contradicted")).drop("contradicted")


def structured_page(rows: DataFrame, predicate: Column, key: str, expected: int | None = None) -> DataFrame:
    """Rows of a conjunction by key; raises if the store announced another number of them."""
    out = rows.filter(predicate)
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} rows of {expected} announced")
    return out.select(key)


def reconstruction(original: DataFrame, prepared: DataFrame, by: list[str], residue: str, atom: str) -> DataFrame:
    """Prepared against observed heavy atoms of an owner: atoms lost and rebuilt, their share, affected residues, category."""
    seen = lambda df, was: df.select(*by, residue, atom, F.lit(was).alias("was"), F.lit(not was).alias("is"))
    unlike = F.when(F.greatest(*(F.col(c).isNull() for c in (*by, residue, atom))), F.col("was"))  # nulls are equal to nothing
    both = dealt(seen(original, True).unionAll(seen(prepared, False)), by).groupBy(*by, residue, atom, unlike.alias("_unlike")).agg(F.bool_or("was").alias("was"), F.bool_or("is").alias("is"))
    lost, new = ~F.col("is"), ~F.col("was")
    r = both.groupBy(*by, residue).agg(F.count_if(lost).alias("missing"), F.count_if(new).alias("rebuilt"), F.count_if(~new).alias("observed"), F.count_if(new & (F.col(atom) != "OXT")).alias("inner"))
    known = F.col(residue).isNotNull()
    a = r.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("missing", "rebuilt", "observed", "inner")), F.count_if(known & (F.col("rebuilt") > 0)).alias("affected"), F.count_if(known & (F.col("observed") > 0)).alias("residues"))
    category = F.when(F.col("rebuilt") == 0, "observed_only").when(F.col("inner") == 0, "terminal_oxygen_only").otherwise("sidechain_completion")
    return a.select(*by, "missing", "rebuilt", "affected", ratio(F.col("rebuilt"), F.col("observed")).alias("rebuilt_share"), ratio(F.col("affected"), F.col("residues")).alias("affected_share"), category.alias("category"))


def backbone_gaps(atoms: DataFrame, chain: list[str], residue: str, nitrogen: tuple[str, str, str], carbon: tuple[str, str, str], low: float = 0.9, high: float = 1.9) -> DataFrame:
    """Chains by their consecutive residues' carbon to nitrogen distances: links, and those outside [low, high]."""
    w = Window.partitionBy(*chain).orderBy(residue)
    d2 = sum((F.col(n) - F.lag(c).over(w)) * (F.col(n) - F.lag(c).over(w)) for n, c in zip(nitrogen, carbon, strict=True))
    return atoms.withColumn("d", F.sqrt(d2)).groupBy(*chain).agg(F.count("d").alias("links"), F.count_if((F.col("d") < low) | (F.col("d") > high)).alias("broken"), F.max("d").alias("longest"))


def sequence_context(observed: DataFrame, complete: DataFrame, chain: str, place: str, token: str) -> DataFrame:
    """Observed residues on the complete sequence by address: every position with its observed token or '-', and whether a token disagrees."""
    c = complete.select(chain, place, F.col(token).alias("complete"))
    j = c.join(observed.select(chain, place, F.col(token).alias("observed")), [chain, place], "left")
    return j.select(chain, place, "complete", F.coalesce("observed", F.lit("-")).alias("observed"), F.coalesce(F.col("observed") != F.col("complete"), F.lit(False)).alias("mismatch"))


def global_places(local: DataFrame, members: DataFrame, member: str, index: str, size: str) -> DataFrame:
    """Local indices as places of one concatenated array: the sizes of the members before, plus the index (-1 stays).

    members: one row each; sizes are added up member by member, so this is for batches, not for a corpus.
    """
    before = members.withColumn("offset", F.coalesce(F.sum(size).over(Window.orderBy(member).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = local.join(before.select(member, "offset"), member)
    return j.withColumn("place", F.when(F.col(index) < 0, F.lit(-1)).otherwise(F.col("offset") + F.col(index)).cast("long")).drop("offset")
