"""Splits that keep related records together: grouped iterative stratification.

Mails are linked by the sender's mailbox and by processes that their bodies name. Mailboxes
are contracted to one node first (a minimum per mailbox, combined on the map side), so a
mailbox with a third of all mails is one node; processes then link nodes, and
:func:`pauta.components.components` finds the connected components.

Placement: label vectors are summed per component. Labels are taken by rarity, the rarest
outstanding first; the components that hold it and aren't placed yet are dealt to the splits
by what each still needs of that label, the largest components first, into the split that
needs most first. The needs of all labels are then updated before the next label. One rule
for components of every size: they lie along a running sum, and the needs are intervals of
it. The ``LABELS`` most frequent labels have needs of their own, the others one together.

Defined results: null and empty addresses and bodies link nothing; a null or empty label is
a label of its own; repeated rows are one record; an empty table gives no rows. The split
shares are met to within the size of the largest components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pauta.cluster import cut_lineage
from pauta.components import components
from pauta.llm.lookalikes import jvm_plain

BUCKETS = 1024
LABELS = 32
OTHER = "\x00other"
MOST_SPLITS = 1000

PROCESS = r"(?iu)(?<![\p{L}\p{N}])(?:processos?|procs?\.?[ºo°]?|p\.?\s?[ºo°]\.?)[\s:]*(?:n\.?\s?[ºo°]\.?|num\.|número)?\s*[-–]?\s*([0-9]{1,12})\s*[/.–-]\s*([0-9]{1,12})(?![0-9])"
YEAR = "^(?:19|20)[0-9]{2}$"


def mailbox(address: Column) -> Column:
    """The mailbox that an address denotes, in lower case; null where there is none."""
    a = F.lower(address)
    inner = F.regexp_extract(a, r"(?s).*<([^<>]*)>", 1)
    a = F.when(inner != "", inner).otherwise(a)
    a = F.regexp_replace(F.regexp_replace(a, r"(?U)[\s<>\"'()\[\]]+", ""), "^mailto:", "")
    a = F.regexp_replace(a, r"\+[^@]*@", "@")
    return F.when(a.rlike("^[^@]+@[^@]+$"), a)


def processes(body: Column) -> Column:
    """Distinct process keys ``year/number`` that a text names; leading zeros dropped, the year on either side."""
    text = jvm_plain(body)
    first, second = F.regexp_extract_all(text, F.lit(PROCESS), F.lit(1)), F.regexp_extract_all(text, F.lit(PROCESS), F.lit(2))
    bare = lambda n: F.regexp_replace(n, "^0+(?=[0-9])", "")
    key = lambda a, b: F.when(a.rlike(YEAR), F.concat(a, F.lit("/"), bare(b))).when(b.rlike(YEAR), F.concat(b, F.lit("/"), bare(a)))
    return F.array_distinct(F.array_compact(F.zip_with(first, second, key)))


def related(mails: DataFrame) -> DataFrame:
    """(id, group_id) of every mail; group_id is the smallest id it is linked to, itself included."""
    base = mails.where("id is not null").select(F.col("id").cast("bigint").alias("id"), mailbox(F.col("sender_email")).alias("box"), processes(F.col("body")).alias("named"))
    base = cut_lineage(base.select("id", "box", "named"))
    boxes = base.where("box is not null").groupBy("box").agg(F.min("id").alias("node"))
    nodes = base.join(boxes, "box", "left").select("id", F.coalesce("node", "id").alias("node"), "named")
    named = nodes.select("node", F.explode("named").alias("process")).distinct()
    first = named.groupBy("process").agg(F.min("node").alias("low"))
    by_process = named.join(first, "process").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    # two rows of one id with different senders or bodies would link too
    low_of_id = nodes.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("a")).where("a <> b").select("a", "b")
    labels = components(by_process.union(low_of_id))
    return nodes.select("id", "node").distinct().join(labels.withColumnRenamed("id", "node"), "node", "left").groupBy("id").agg(F.min(F.coalesce("group_id", "node")).alias("group_id"))


def group_pairs(mails: DataFrame) -> DataFrame:
    """(group_id, id): the smallest id of each group with each other id of the group."""
    return related(mails).where("group_id <> id").select("group_id", "id")


def label_name(c: str) -> Column:
    plain = F.translate(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))), "áàâãéêíóôõúç", "aaaaeeiooouc")
    return F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "_"), "^_+|_+$", "")


def _strata(comps: DataFrame, labels: list[str]) -> list[str]:
    """Labels in the order in which their components are placed: each time the rarest outstanding one.

    Outstanding are the records of components without a label placed before, so the order
    depends on no placement.
    """
    order: list[str] = []
    while len(order) < len(labels):
        left = comps.where(~F.arrays_overlap(F.map_keys("vector"), F.array(*[F.lit(k) for k in order]).cast("array<string>"))) if order else comps
        counts = {r["label"]: r["n"] for r in left.select(F.explode("vector").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n")).collect()}
        rest = [k for k in labels if counts.get(k)]
        if not rest:
            break
        order.append(min(rest, key=lambda k: (counts[k], k)))
    return order


def _placed(own: DataFrame, label: str, lanes: list[tuple[str, float]]) -> DataFrame:
    """``own (group_id, vector)`` with ``split``: components by size class, largest first, along the running sum of ``label``.

    The sum runs over ``BUCKETS`` hash buckets a size class, so no task gets a class whole;
    the offsets collected are at most 4 * 64 * ``BUCKETS`` numbers, whatever the data.
    """
    n = F.element_at("vector", F.lit(label))
    own = own.withColumns({"n": n, "class": (-F.floor(4 * F.log2(n))).cast("int"), "bucket": F.pmod(F.xxhash64("group_id"), F.lit(BUCKETS)).cast("int")})
    sums = sorted((r["class"], r["bucket"], r["n"]) for r in own.groupBy("class", "bucket").agg(F.sum("n").alias("n")).collect())
    run, offsets = 0, []
    for c, b, k in sums:
        offsets.append((c, b, run))
        run += k
    scale = run / (sum(w for _, w in lanes) or 1.0)
    edge, cut = 0.0, F.lit(lanes[-1][0])
    edges = []
    for name, w in lanes:
        edge += w * scale
        edges.append((name, edge))
    for name, e in reversed(edges[:-1]):
        cut = F.when(F.col("at") < e, F.lit(name)).otherwise(cut)
    at = F.sum("n").over(W.partitionBy("class", "bucket").orderBy("group_id")) - F.col("n") / 2 + F.col("start")
    starts = F.broadcast(own.sparkSession.createDataFrame(offsets, "class int, bucket int, start bigint"))
    return own.join(starts, ["class", "bucket"]).withColumn("at", at).select("group_id", "vector", cut.alias("split"))


def grouped_splits(mails: DataFrame, targets: DataFrame, label: str = "label") -> DataFrame:
    """(id, group_id, split) of every mail; all mails of a group get the same split."""
    groups = cut_lineage(related(mails))
    named = mails.where("id is not null").groupBy(F.col("id").cast("bigint").alias("id")).agg(F.min(label_name(label)).alias("label"))
    counts = cut_lineage(groups.join(named, "id").groupBy("group_id", "label").agg(F.count("*").alias("n")))
    shares = {r["split_name"]: float(r["share"]) for r in targets.select("split_name", "share").limit(MOST_SPLITS).collect()}
    whole = sum(shares.values()) or 1.0
    if not shares:
        return groups.select("id", "group_id", F.lit(None).cast("string").alias("split"))
    top = counts.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS).collect()
    kept = [r["label"] for r in top]
    pooled = F.when(F.col("label").isin(*kept), F.col("label")).otherwise(F.lit(OTHER)) if kept else F.lit(OTHER)
    vectors = counts.groupBy("group_id", pooled.alias("label")).agg(F.sum("n").alias("n")).groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("vector"))
    comps = cut_lineage(vectors)  # a vector has at most LABELS + 1 entries
    totals = {r["label"]: r["n"] for r in comps.select(F.explode("vector").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n")).collect()}
    need = {s: {k: shares[s] / whole * n for k, n in totals.items()} for s in shares}
    before: list[str] = []
    out = []
    for k in _strata(comps, list(totals)):
        has = lambda ls: F.arrays_overlap(F.map_keys("vector"), F.array(*[F.lit(x) for x in ls]).cast("array<string>"))
        own = comps.where(has([k]) & (~has(before) if before else F.lit(True)))
        lanes = sorted(((s, max(0.0, need[s][k])) for s in shares), key=lambda x: (-x[1], x[0]))
        placed = cut_lineage(_placed(own, k, lanes))
        for r in placed.select("split", F.explode("vector").alias("label", "n")).groupBy("split", "label").agg(F.sum("n").alias("n")).collect():
            need[r["split"]][r["label"]] -= r["n"]
        out.append(placed.select("group_id", "split"))
        before.append(k)
    if not out:
        return groups.select("id", "group_id", F.lit(None).cast("string").alias("split"))
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    return groups.join(every, "group_id").select("id", "group_id", "split")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, records, groups, share, wanted) of an assignment."""
    total = F.sum("records").over(W.partitionBy())  # over one row a split
    got = assigned.groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("group_id").alias("groups"))
    return got.withColumn("share", F.round(F.col("records") / total, 6)).join(F.broadcast(targets.select(F.col("split_name").alias("split"), F.col("share").alias("wanted")).limit(MOST_SPLITS)), "split", "left")


def label_shares(assigned: DataFrame, mails: DataFrame, targets: DataFrame, label: str = "label") -> DataFrame:
    """(label, split, records, share, wanted): how each label's records are dealt to the splits."""
    named = mails.where("id is not null").groupBy(F.col("id").cast("bigint").alias("id")).agg(F.min(label_name(label)).alias("label"))
    got = assigned.join(named, "id").groupBy("label", "split").agg(F.count("*").alias("records"))
    whole = got.groupBy("label").agg(F.sum("records").alias("every"))
    wanted = targets.select(F.col("split_name").alias("split"), F.col("share").alias("wanted")).limit(MOST_SPLITS)
    return got.join(whole, "label").join(F.broadcast(wanted), "split", "left").select("label", "split", "records", F.round(F.col("records") / F.col("every"), 6).alias("share"), "wanted")


def split_check(assigned: DataFrame, targets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: records, groups in more than one split, and whether every share is met.

    A share is met where it deviates by no more than ``tolerance`` or half the largest group's share.
    """
    groups = assigned.groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"))
    of_groups = groups.agg(F.lit(1).alias("one"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count_if(F.col("splits") > 1).alias("divided_groups"), F.max("n").alias("largest"))
    off = split_report(assigned, targets).agg(F.lit(1).alias("one"), F.max(F.abs(F.col("share") - F.col("wanted"))).alias("off"))
    met = F.coalesce(F.col("off") <= F.greatest(F.lit(tolerance), F.col("largest") / F.col("records") / 2), F.lit(True))
    return of_groups.join(off, "one").select("records", "divided_groups", met.alias("shares_met"))  # one row each
