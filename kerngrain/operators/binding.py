"""Binding of events to containers and pods."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import container_of_path, container_of_uri, controlling_owner
from .lineage import as_of


def latest_pods(changes: DataFrame) -> DataFrame:
    """Changes (op, seq, pod_uid, ...) to the last snapshot of each pod that isn't deleted. Combines before the shuffle."""
    last = changes.groupBy("pod_uid").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "pod_uid"]), "seq").alias("last"))
    return last.where("last.op <> 'delete'").select("pod_uid", "last.*")


def watch_changes(watch: DataFrame, span: int = 1 << 16) -> DataFrame:
    """A watch (cluster, seq, op, pod_uid, pod) to the applies and deletes it amounts to, one row each, with their seq.

    op is apply, delete, init, init_apply or init_done. A listing from init to init_done deletes, at its end, the pods whose last row is older than its
    begin; one that another init interrupts deletes nothing. A delete of a pod that isn't there is none. A row looks for the one whole listing
    that begins next after it, by windows over ``span`` numbers of a cluster (``as_of``, from behind), whatever the number of listings; each pod's rows are a window.
    """
    marks = watch.where("op in ('init', 'init_done') and cluster is not null").select("cluster", "seq", "op", F.col("seq").alias("begin"))
    ends = marks.select("cluster", (-F.col("seq")).alias("at"), F.col("seq").alias("end"), F.col("op").alias("end_op"))
    begun = as_of(marks.where("op = 'init'").withColumn("behind", -1 - F.col("seq")), ends, ["cluster"], "behind", "at", ["end", "end_op"], span)
    listings = begun.where("end_op = 'init_done'").select("cluster", (-F.col("begin")).alias("at"), F.col("end").alias("gone"))
    by = Window.partitionBy("cluster", "pod_uid").orderBy("seq")
    rows = watch.where("op in ('apply', 'init_apply', 'delete')").select("cluster", "seq", "op", "pod_uid", "pod", (-1 - F.col("seq")).alias("behind"))
    rows = as_of(rows, listings, ["cluster"], "behind", "at", ["gone"], span)
    rows = rows.withColumns({"gone": F.when(F.col("op") != "delete", F.col("gone")), "next": F.lead("seq").over(by)})
    listed_out = F.col("gone").isNotNull() & F.coalesce(F.col("gone") < F.col("next"), F.lit(True))
    rows = rows.withColumns({"was": F.lag(F.when((F.col("op") != "delete") & ~listed_out, True)).over(by), "listed_out": listed_out})
    own = rows.where("op <> 'delete' or was").select("cluster", "seq", F.when(F.col("op") == "delete", "delete").otherwise("apply").alias("op"), "pod_uid", F.when(F.col("op") != "delete", F.col("pod")).alias("pod"))
    return own.unionByName(rows.where("listed_out").select("cluster", F.col("gone").alias("seq"), F.lit("delete").alias("op"), "pod_uid", F.lit(None).cast("string").alias("pod")))


#: What a binding tells of a pod beside its number and namespace, where the inventory has it.
OF_POD = ("pod_name", "service_account", "owner_kind", "owner_name", "owner_uid")


def flatten_pods(pods: DataFrame) -> DataFrame:
    """Pods with arrays of container URIs, by kind of status, to a row for each container: container_id, pod_uid, namespace, and of OF_POD and seq what there is.

    ``owners`` (controller, kind, name, uid) gives the controlling owner, if all its parts are filled. Pods without uid, name or namespace are skipped.
    """
    kinds = [F.coalesce(c, F.array().cast("array<string>")) for c in ("containers", "init_containers", "ephemeral_containers") if c in pods.columns]
    whole = " and ".join(f"{c} is not null" for c in ("pod_uid", "pod_name", "namespace") if c in pods.columns)
    rows = pods.where(whole)
    if "owners" in pods.columns:
        owner = controlling_owner(F.col("owners"))
        rows = rows.withColumns({f"owner_{x}": owner[x] for x in ("kind", "name", "uid")})
    more = [c for c in (*OF_POD, "seq") if c in rows.columns]
    rows = rows.select("pod_uid", "namespace", *more, F.explode(F.concat(*kinds)).alias("uri"))
    return rows.select(container_of_uri(F.col("uri"))["id"].alias("container_id"), "pod_uid", "namespace", *more).where("container_id is not null")


def resynced(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Pods that a full listing no longer has."""
    return known.join(seen.select("pod_uid"), "pod_uid", "left_anti")


def bind(events: DataFrame, cgroups: DataFrame, pods: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Events with container_id, pod_uid, namespace, provenance and unbound_reason.

    cgroups: cluster, node_id, cgroup_id, path, as numbers of cgroups repeat between nodes. live (cluster, node_id, pid, path) is
    looked at first and is observed; the inventory of cgroups is derived. Inventories are joined as they are: Spark
    broadcasts one whose size is below the threshold, and shuffles by key beyond it. Events without a cgroup or container,
    of which there are many, are dealt evenly under keys that no inventory has.
    """
    node = ["cluster", "node_id"]
    spread = F.pmod(F.xxhash64("event_id"), F.lit(1 << 20))
    listed = cgroups.groupBy(*node, F.col("cgroup_id").alias("key_")).agg(F.max("path").alias("listed"))
    rows = events.withColumn("key_", F.when(F.col("cgroup_id") != 0, F.col("cgroup_id")).otherwise(-1 - spread)).join(listed, [*node, "key_"], "left").drop("key_")
    if live is not None:
        rows = rows.join(live.groupBy(*node, "pid").agg(F.max("path").alias("live")), [*node, "pid"], "left")
    else:
        rows = rows.withColumn("live", F.lit(None).cast("string"))
    own = container_of_path(F.col("live"))
    rows = rows.withColumn("box", F.coalesce(own, container_of_path(F.col("listed"))))
    rows = rows.withColumns({"container_id": F.when(F.col("cgroup_id") != 0, F.col("box.id")), "provenance": F.when(own.isNotNull(), "observed").when(F.col("box").isNotNull(), "derived")})
    of_pod = ["pod_uid", "namespace", *[c for c in OF_POD if c in pods.columns]]
    newest = F.struct(*[F.col(c) for c in ("seq", "pod_uid") if c in pods.columns])  # of two pods that claim a container
    known = pods.groupBy(F.lower("container_id").alias("key_")).agg(F.max_by(F.struct(*of_pod), newest).alias("pod_")).select("key_", "pod_.*")
    rows = rows.withColumn("key_", F.coalesce("container_id", F.concat(F.lit("none "), spread))).join(known, "key_", "left").drop("key_")
    path = F.coalesce("live", "listed")
    reason = F.when(F.col("cgroup_id") == 0, "no_cgroup").when(path.isNull(), "cache_miss").when(F.col("container_id").isNull(), "host_process").when(F.col("pod_uid").isNull(), "cache_miss")
    out = rows.withColumn("unbound_reason", reason)
    return out.withColumns({c: F.when(F.col("unbound_reason").isNull(), F.col(c)) for c in ("container_id", *of_pod, "provenance")}).drop("box", "live", "listed")


#: What a resolver is asked about.
ASKED = ("cluster", "node_id", "cgroup_id", "pid")


def resolved(events: DataFrame, *resolvers: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """UD3: events with what the first of the resolvers tells that knows their container or pod, and ``resolver``, its place from 0; else nulls.

    A resolver is a function from rows of ASKED, each once, to rows of these with container_id, pod_uid and anything else; columns of these names that
    events have are replaced. Of several rows of one resolver the one of the smallest container and pod goes. All are asked about all keys,
    which are far fewer than events, and their rows meet in one aggregation.
    """
    keys = events.select(*ASKED).distinct()
    told = [f(keys).withColumn("resolver", F.lit(i)) for i, f in enumerate(resolvers)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), told).where("container_id is not null or pod_uid is not null")
    more = [c for c in rows.columns if c not in ASKED]
    best = rows.groupBy(*ASKED).agg(F.min_by(F.struct(*more), F.struct("resolver", "container_id", "pod_uid")).alias("best_"))
    return events.drop(*more).join(best, list(ASKED), "left").select(*[c for c in events.columns if c not in more], *[F.col(f"best_.{c}").alias(c) for c in more])


def coverage(bound: DataFrame) -> DataFrame:
    """Hits, misses and their ratio, 0 without any."""
    return bound.agg(F.count_if(F.col("unbound_reason").isNull()).alias("hits"), F.count_if(F.col("unbound_reason").isNotNull()).alias("misses")).withColumn("ratio", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))


def bounded(rows: DataFrame, per: str, first_seen: str, tie: str, n: int) -> DataFrame:
    """The newest n by first appearance for each node. Spark limits each group before the shuffle."""
    newest = Window.partitionBy(per).orderBy(F.desc(first_seen), F.desc(tie))
    return rows.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n).drop("rn")
