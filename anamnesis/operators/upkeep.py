"""Curation of the store: decay, reorganisation, chapters, audits and backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.functions.text import clip, theme_name
from anamnesis.operators.merging import may_supersede, tombstones_of, without_tombstoned
from anamnesis.operators.ranking import numbered
from anamnesis.operators.selection import owned
from anamnesis.schema import KINDS, conform

DECAY_DAYS, DECAY_BELOW = 90, 0.7
WARM_DAYS, KEPT_EVIDENCE = 30, 5
MATURE, LEAST_MEMBERS, MOST_SUBS, MOST_DOMAINS = 5, 2, 6, 12
LEAST_STORE, TARGET_SIZE = 10, 500
COVERED = 0.5


def decayed(memories: DataFrame, as_of: Column, days: int = DECAY_DAYS, below: float = DECAY_BELOW) -> DataFrame:
    """Active, unpinned inferences of little confidence that weren't seen for so long."""
    return memories.where(
        (F.col("status") == "active")
        & (F.col("pinned") == 0)
        & (F.col("origin") == "agent_inferred")
        & (F.col("confidence") < below)
        & (F.col("last_seen") < F.date_sub(as_of, days))
    )


def archive(memories: DataFrame, ids: DataFrame, reason: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """The store with the rows of ``ids`` archived, and their tombstones."""
    gone = memories.join(ids.select("id").distinct(), "id", "left_semi")
    marked = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    after = memories.join(marked, "id", "left").withColumn("status", F.when(F.col("_gone"), "archived").otherwise(F.col("status")))
    return after.select(*memories.columns), tombstones_of(gone, reason, at)


def flexible(memories: DataFrame, owner: str = "default") -> DataFrame:
    """Active memories that count against the target size: neither pinned nor settled habits."""
    habit = (F.col("kind") == "preference") & (F.col("evidence") >= 5) & (F.col("confidence") >= 0.8)
    return owned(memories, owner).where(~((F.col("pinned") == 1) | habit))


def merged_groups(memories: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group of duplicates. ``groups`` has ``group_id, place, id``; only ids of ``memories``
    count, and groups of one fall away. Kind, domain, origin and directory are those of the
    most confident row (the first of equals), the source is the first that isn't null."""
    rows = groups.join(memories, "id")
    best = F.max_by(F.struct("kind", "domain", "origin", "cwd"), F.struct("confidence", -F.col("place"))).alias("best")
    first = F.min_by("source", F.when(F.col("source").isNotNull(), F.col("place"))).alias("source")
    out = rows.groupBy("group_id").agg(
        F.sum("evidence").alias("evidence"), F.max("confidence").alias("confidence"), F.max("last_seen").alias("last_seen"),
        F.count("*").alias("members"), best, first,
    )
    return out.where("members >= 2").select("group_id", "evidence", "confidence", "last_seen", "members", "best.*", "source")


def allowed_conflicts(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """``keep_id, drop_id`` of known, different rows of which the first may retire the second."""
    side = lambda name: memories.select(F.col("id").alias(f"{name}_id"), F.col("origin").alias(f"{name}_origin"), F.col("confidence").alias(f"{name}_confidence"))
    rows = pairs.where("keep_id != drop_id").join(side("keep"), "keep_id").join(side("drop"), "drop_id")
    gate = may_supersede(F.col("drop_origin"), F.col("drop_confidence"), F.col("keep_origin"), F.col("keep_confidence"))
    return rows.where(gate).select("keep_id", "drop_id")


def reorganise(memories: DataFrame, merges: DataFrame, conflicts: DataFrame, archives: DataFrame, retags: DataFrame, tombstones: DataFrame, owner: str, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A curation plan's four phases in order: merges, conflicts, archives, retags. Ids are checked
    against the store before any phase, and a later phase overwrites what an earlier one set.

    ``merges``: ``group_id, summary, content, keywords, ids``; ``conflicts``: ``keep_id, drop_id``;
    ``archives``: ``id``; ``retags``: ``id, kind, domain``. Returns the changed fields by id, the merged
    rows to insert (with ``group_id``), and new tombstones. A merge whose text is tombstoned
    leaves its sources alone; a store of under ten rows isn't curated.
    """
    active = owned(memories, owner)
    large = active.select("id").limit(LEAST_STORE).count() >= LEAST_STORE
    active = active.where(F.lit(large))
    usable = merges.where((F.length(F.coalesce("summary", F.lit(""))) > 0) & (F.length(F.coalesce("content", F.lit(""))) > 0))
    usable = without_tombstoned(usable.withColumn("owner", F.lit(owner)), tombstones)
    groups = usable.select("group_id", F.posexplode("ids").alias("place", "id"))
    made = merged_groups(active, groups).join(usable.select("group_id", "summary", "content", "keywords"), "group_id")
    members = groups.join(active.select("id"), "id", "left_semi").join(made.select("group_id"), "group_id", "left_semi")
    gone = archives.join(active.select("id"), "id", "left_semi").select("id").distinct()
    text = lambda value: F.lit(value).cast("string")
    steps = [
        members.groupBy("id").agg(F.max("group_id").alias("by_group")).select("id", F.lit(1).alias("phase"), text("superseded").alias("status"), "by_group", F.lit(None).cast("long").alias("by_id")),
        allowed_conflicts(active, conflicts).groupBy(F.col("drop_id").alias("id")).agg(F.max("keep_id").alias("by_id")).select("id", F.lit(2).alias("phase"), text("superseded").alias("status"), F.lit(None).cast("long").alias("by_group"), "by_id"),
        gone.select("id", F.lit(3).alias("phase"), text("archived").alias("status"), F.lit(None).cast("long").alias("by_group"), F.lit(None).cast("long").alias("by_id")),
    ]
    status = steps[0].unionByName(steps[1]).unionByName(steps[2])
    pointed = F.when(F.col("phase") < 3, F.col("phase"))
    status = status.groupBy("id").agg(F.max_by("status", "phase").alias("status"), F.max_by(F.struct("by_group", "by_id"), pointed).alias("by"))
    tags = retags.join(active.select("id"), "id", "left_semi").select("id", F.when(F.col("kind").isin(*KINDS), F.col("kind")).alias("kind"), F.nullif("domain", F.lit("")).alias("domain"))
    tags = tags.groupBy("id").agg(F.last("kind", True).alias("kind"), F.last("domain", True).alias("domain"))
    changes = status.join(tags, "id", "full").select("id", "status", "by.by_group", "by.by_id", "kind", "domain")
    return changes, made.withColumn("owner", F.lit(owner)), tombstones_of(active.join(gone, "id", "left_semi"), "archived", at)


def reorganised(memories: DataFrame, changes: DataFrame, made: DataFrame, at: Column) -> DataFrame:
    """The store after a curation plan (see ``reorganise``): merged rows get new ids, and what they or
    other rows replace points to them."""
    top = memories.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    born = numbered(made, "group_id", name="_n").withColumn("id", F.col("_n") + top)
    named = changes.join(born.select(F.col("group_id").alias("by_group"), F.col("id").alias("_new")), "by_group", "left")
    named = named.select("id", *(F.col(c).alias(f"_{c}") for c in ("status", "kind", "domain")), F.coalesce("_new", "by_id").alias("_by"), F.lit(True).alias("_hit"))
    rows = memories.join(named, "id", "left")
    kept = rows.withColumns(
        {c: F.coalesce(f"_{c}", c) for c in ("status", "kind", "domain")}
        | {"superseded_by": F.coalesce("_by", "superseded_by"), "updated_at": F.when(F.col("_hit"), at).otherwise(F.col("updated_at"))}
    ).select(*memories.columns)
    words = F.array_join(F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 8), " ")
    fresh = born.withColumns({"keywords": words, "status": F.lit("active"), "created_at": at, "updated_at": at, "last_seen_at": F.col("last_seen").cast("timestamp")})
    return kept.unionByName(conform(fresh, "memories").select(*memories.columns))


def chapters(tree: DataFrame, memories: DataFrame, owner: str = "default") -> DataFrame:
    """A cluster tree's chapters as they will be kept: known members only, at least two, up to six
    chapters in a domain and twelve domains. ``tree`` has ``domain_place, domain, sub_place, sub, member_ids``."""
    known = owned(memories, owner).select(F.col("id").alias("member"))
    rows = tree.withColumns({"domain": theme_name(F.col("domain")), "sub": theme_name(F.col("sub"))})
    members = rows.select("domain_place", "domain", "sub_place", "sub", F.explode("member_ids").alias("member")).join(known, "member", "left_semi")
    subs = members.groupBy("domain_place", "domain", "sub_place", "sub").agg(F.array_sort(F.collect_set("member")).alias("member_ids"))
    subs = subs.where((F.size("member_ids") >= LEAST_MEMBERS) & (F.col("domain") != ""))
    place = F.row_number().over(Window.partitionBy("domain_place").orderBy("sub_place"))
    subs = subs.withColumn("_sub", place).where(F.col("_sub") <= MOST_SUBS).drop("_sub")
    # a model's tree has few domains; the number of different places is what is ranked
    first = subs.select("domain_place").distinct().orderBy("domain_place").limit(MOST_DOMAINS)
    out = subs.join(first, "domain_place", "left_semi")
    mature = F.when(F.size("member_ids") >= MATURE, "mature").otherwise("seeding")
    return out.select(F.concat_ws("/", "domain", "sub").alias("theme"), "domain", "sub", "member_ids", mature.alias("maturity"))


def grown_chapters(found: DataFrame, profiles: DataFrame, memories: DataFrame, owner: str) -> DataFrame:
    """Chapters (of ``chapters``) with the members that they had before, as far as those are active or
    absorbed, and a row for each domain: ``theme, domain, title, member_ids, maturity, is_domain``."""
    old = profiles.where(F.col("owner") == owner).select("theme", F.col("memory_ids").alias("_old"))
    joined = found.join(old, "theme", "left").withColumn("_all", joined_members(F.col("_old"), F.col("member_ids")))
    living = owned(memories, owner, ("active", "absorbed")).select(F.col("id").alias("_id"))
    members = joined.select("theme", "domain", "sub", F.posexplode("_all").alias("_at", "_id")).join(living, "_id")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_id"))), lambda x: x["_id"])
    mature = F.when(F.size("member_ids") >= MATURE, "mature").otherwise("seeding").alias("maturity")
    subs = members.groupBy("theme", "domain", "sub").agg(in_order.alias("member_ids"))
    roots = members.groupBy("domain").agg(F.array_sort(F.collect_set("_id")).alias("member_ids"))
    shape = lambda theme, title, root: [F.col(theme).alias("theme"), "domain", F.col(title).alias("title"), "member_ids", mature, F.lit(root).alias("is_domain")]
    return subs.select(*shape("theme", "sub", False)).unionByName(roots.select(*shape("domain", "domain", True)))


def with_ids(profiles: DataFrame, at: Column) -> DataFrame:
    """Profiles of which new ones get ids, in the order of owner and theme."""
    top = profiles.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(profiles.where("id IS NULL").drop("id"), "owner", "theme", name="id")
    new = new.withColumns({"id": F.col("id") + top, "created_at": at})
    return profiles.where("id IS NOT NULL").unionByName(new.select(*profiles.columns))


def absorbed(memories: DataFrame, taken: DataFrame, at: Column) -> DataFrame:
    """The store after chapters took members in (``id, absorbed_by``)."""
    rows = memories.join(taken.select("id", F.col("absorbed_by").alias("_by")), "id", "left")
    hit = F.col("_by").isNotNull()
    changed = {"status": F.when(hit, "absorbed").otherwise(F.col("status")), "absorbed_by": F.coalesce("_by", "absorbed_by"), "updated_at": F.when(hit, at).otherwise(F.col("updated_at"))}
    return rows.withColumns(changed).select(*memories.columns)


def audit_batches(memories: DataFrame, owner: str = "default", size: int = 12) -> DataFrame:
    """Active lessons in batches for an audit: ``id, batch``."""
    rows = numbered(owned(memories, owner).where("kind = 'lesson'").select("id"), "id")
    return rows.select("id", F.floor((F.col("number") - 1) / size).cast("long").alias("batch"))


def audit_trail(memories: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``id, verdict, before, after``: what an audit changes, for a dry run or the log."""
    after = audited(memories, verdicts).select("id", "verdict", F.to_json(F.struct("summary", "content", "kind", "status")).alias("after"))
    return after.join(memories.select("id", F.to_json(F.struct("summary", "content", "kind", "status")).alias("before")), "id").select("id", "verdict", "before", "after")


def changed(memories: DataFrame, rows: DataFrame, at: Column) -> DataFrame:
    """The store with the columns that ``rows`` has, by ``id``, in place of its own."""
    names = [c for c in rows.columns if c in memories.columns and c != "id"]
    joined = memories.join(rows.select("id", *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_hit")), "id", "left")
    values = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in names} | {"updated_at": F.when(F.col("_hit"), at).otherwise(F.col("updated_at"))}
    return joined.withColumns(values).select(*memories.columns)


def upsert_profiles(profiles: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """Profiles after an upsert by owner and theme: the version rises, members are the given ones,
    a blank abstract keeps the old one, and a retired theme that comes back is active again."""
    new = changes.select("owner", "theme", *(F.col(c).alias(f"_{c}") for c in ("title", "abstract", "content", "memory_ids", "maturity", "parent_id")))
    new = new.withColumn("_new", F.lit(True))
    rows = profiles.join(new, ["owner", "theme"], "full")
    changed = F.coalesce("_new", F.lit(False))
    pick = lambda c: F.when(changed, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(
        "id", "owner", "theme", pick("title"),
        F.coalesce(F.nullif("_abstract", F.lit("")), "abstract", F.lit("")).alias("abstract"),
        pick("content"), pick("memory_ids"), pick("maturity"),
        F.when(changed, "active").otherwise(F.col("status")).alias("status"),
        (F.coalesce("version", F.lit(0)) + F.when(changed, 1).otherwise(0)).cast("long").alias("version"),
        pick("parent_id"),
        F.when(changed, at).otherwise(F.col("updated_at")).alias("updated_at"), *(c for c in ("created_at",) if c in profiles.columns),
    )


def joined_members(old: Column, new: Column) -> Column:
    """Earlier members first, then new ones, each once."""
    return F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<long>")), new))


def absorbable(as_of: Column) -> Column:
    return (
        (F.col("status") == "active")
        & (F.col("pinned") == 0)
        & (F.col("evidence") < KEPT_EVIDENCE)
        & (F.datediff(as_of, F.col("last_seen")) > WARM_DAYS)
    )


def absorb(memories: DataFrame, profiles: DataFrame, as_of: Column) -> DataFrame:
    """``id, absorbed_by`` of members that mature sub-chapters take in; the last chapter of several."""
    mature = profiles.where((F.col("maturity") == "mature") & F.col("parent_id").isNotNull())
    members = mature.select(F.col("id").alias("profile"), F.explode("memory_ids").alias("id")).groupBy("id").agg(F.max("profile").alias("absorbed_by"))
    return memories.where(absorbable(as_of)).select("id").join(members, "id")


def retired(profiles: DataFrame, memories: DataFrame, covered: DataFrame, touched: DataFrame) -> DataFrame:
    """Untouched chapters that new ones replace: the same title, at least half of the loadable members
    covered, or nothing loadable. ``covered`` has ``id``; ``touched`` has ``theme, title``."""
    old = profiles.join(touched.select("theme"), "theme", "left_anti")
    members = old.select(F.col("id").alias("profile"), F.explode("memory_ids").alias("id")).join(
        memories.where(F.col("status").isin("active", "absorbed")).select("id"), "id"
    )
    members = members.join(covered.select("id").distinct().withColumn("_covered", F.lit(1)), "id", "left")
    share = members.groupBy("profile").agg(F.count("*").alias("loadable"), F.count("_covered").alias("covered"))
    titles = touched.select("title").distinct().withColumn("_same", F.lit(True))
    rows = old.join(share, old["id"] == share["profile"], "left").join(titles, "title", "left")
    loadable, covered_n = F.coalesce("loadable", F.lit(0)), F.coalesce("covered", F.lit(0))
    gone = F.coalesce("_same", F.lit(False)) | (loadable == 0) | (covered_n >= COVERED * loadable)
    return rows.where(gone).select("id", "theme", "title", loadable.alias("loadable"), covered_n.alias("covered"))


def audited(memories: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Lessons with an audit's verdicts applied: ``ok`` leaves, ``rewrite`` replaces texts, ``fact`` changes the
    kind, ``archive`` puts away (without a tombstone). Unknown ids and verdicts fall away."""
    rows = memories.where("status = 'active' AND kind = 'lesson'").join(
        verdicts.where(F.col("verdict").isin("rewrite", "fact", "archive")).select("id", "verdict", F.col("summary").alias("_s"), F.col("content").alias("_c")), "id"
    )
    rewrite = F.col("verdict") == "rewrite"
    return rows.select(
        "id", "verdict",
        F.when(rewrite, F.coalesce(F.nullif("_s", F.lit("")), "summary")).otherwise(F.col("summary")).alias("summary"),
        F.when(rewrite, F.coalesce(F.nullif("_c", F.lit("")), "content")).otherwise(F.col("content")).alias("content"),
        F.when(F.col("verdict") == "fact", "fact").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("verdict") == "archive", "archived").otherwise(F.col("status")).alias("status"),
    )


def backfill_batches(memories: DataFrame, empty: str, size: int = 20, owner: str = "default") -> DataFrame:
    """Active rows whose column ``empty`` is blank, in batches for a model: ``id, batch``."""
    rows = owned(memories, owner).where(F.trim(F.coalesce(empty, F.lit(""))) == "").select("id")
    return numbered(rows, "id").select("id", F.floor((F.col("number") - 1) / size).cast("long").alias("batch"))


def backfilled(memories: DataFrame, found: DataFrame) -> DataFrame:
    """``id, keywords, mini`` where they were empty: up to eight keywords, handles of up to 60 characters."""
    rows = memories.join(found.select("id", F.col("keywords").alias("_k"), F.col("mini").alias("_m")), "id")
    words = F.array_join(F.slice(F.coalesce("_k", F.array().cast("array<string>")), 1, 8), " ")
    return rows.select(
        "id",
        F.when(F.trim("keywords") == "", words).otherwise(F.col("keywords")).alias("keywords"),
        F.when(F.trim("mini") == "", F.substring(F.coalesce("_m", F.lit("")), 1, 60)).otherwise(F.col("mini")).alias("mini"),
    )


def demands(asked: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Counts of wanted domains by owner. ``asked`` has ``owner, domains, at``; the first five of a request count."""
    names = F.filter(F.transform(F.slice("domains", 1, 5), lambda d: F.substring(F.trim(d), 1, 60)), lambda d: d != "")
    rows = asked.select("owner", F.explode(names).alias("domain"), "at", F.lit(1).alias("n"))
    if known is not None:
        rows = rows.unionByName(known.select("owner", "domain", F.col("last_demand_at").alias("at"), F.col("demand_count").alias("n")))
    return rows.groupBy("owner", "domain").agg(F.sum("n").cast("long").alias("demand_count"), F.max("at").alias("last_demand_at"))


def domain_hashes(memories: DataFrame, updated: Column, owner: str = "default") -> DataFrame:
    """``domain, members, hash`` of the active store, to see which domain's card is out of date; the largest
    domains come first.

    A domain's ids come in ranges, each hashed by itself; the ranges' hashes, of which there are a
    thousandth as many, are hashed again. So no row holds a domain's whole list.
    """
    name = F.coalesce(F.nullif(F.trim("domain"), F.lit("")), F.lit("general"))
    rows = owned(memories, owner).select(name.alias("domain"), "id", F.concat_ws(":", F.col("id").cast("string"), updated).alias("mark"))
    part = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "mark"))), lambda x: x["mark"]), ";"))
    ranges = rows.groupBy("domain", F.floor(F.col("id") / 1000).alias("range")).agg(part.alias("hash"), F.count("*").alias("members"))
    whole = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "hash"))), lambda x: x["hash"]), ";"))
    out = ranges.groupBy("domain").agg(F.sum("members").alias("members"), F.substring(whole, 1, 16).alias("hash"))
    return out.orderBy(F.desc("members"), "domain")


def stale_cards(hashes: DataFrame, cards: DataFrame) -> DataFrame:
    """Domains whose card was made from other rows, or not at all; ``cards`` has ``domain, hash``."""
    return hashes.join(cards.select("domain", "hash"), ["domain", "hash"], "left_anti")


def listing(memories: DataFrame, owner: str = "default") -> DataFrame:
    """What a selector reads of the active store, one line per row."""
    shown = F.concat(F.lit("[id "), F.col("id").cast("string"), F.lit("] ("), "kind", F.lit(") "), clip(F.coalesce(F.nullif("mini", F.lit("")), "summary"), 60))
    return owned(memories, owner).select("id", shown.alias("line"))
