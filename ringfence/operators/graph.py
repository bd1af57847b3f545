"""Property-graph patterns as DataFrame joins.

The graph is a bundle of DataFrames (G1); no graph store. Patterns are
written seed-first: every expansion starts from a filtered node set (the
confirmed-fraud accounts, compromised accounts or given targets), so the
work grows with the seed's neighbourhood, never with all pairs of a group.

Join strategy is left to the engine: a seed side that turns out small after
its shuffle is converted to a broadcast hash join by AQE (a runtime size
check against ``spark.sql.adaptive.autoBroadcastJoinThreshold``), and stays
a sort-merge join, with AQE splitting hot device / address keys, when not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIRMED_FRAUD = "CONFIRMED_FRAUD"
VICTIM_COMPROMISED = "VICTIM_COMPROMISED"


class FraudGraph:
    """G1: node and edge tables of the fraud graph.

    accounts(account_id, customer_name, kyc_status)
    devices(device_id, device_type, is_emulator)
    addresses(address_id, full_address, is_commercial_drop)
    used_device(account_id, device_id, ...)      label USED_DEVICE
    shipped_to(account_id, address_id)           label SHIPPED_TO
    transferred(src_account, dst_account, amount, timestamp, ...) label TRANSFERRED

    Each table is a DataFrame or a zero-argument function producing one;
    functions run on first use only (e.g. an edge table that is built and
    written once when a pattern needs it).
    """

    _FIELDS = ("accounts", "devices", "addresses", "used_device", "shipped_to", "transferred")

    def __init__(self, accounts, devices, addresses, used_device, shipped_to, transferred=None,
                 writer=None):
        self._src = dict(zip(self._FIELDS, (accounts, devices, addresses, used_device, shipped_to, transferred)))
        self._done: dict[str, DataFrame | None] = {}
        self._writer = writer

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in self._FIELDS:
            raise AttributeError(name)
        if name not in self._done:
            v = self._src[name]
            self._done[name] = v() if callable(v) else v
        return self._done[name]

    def written(self, *names: str) -> "FraudGraph":
        """The same graph with the named tables written once to the checkpoint
        folder. Patterns that read an edge table several times call this, so
        the joins producing it run once. A graph may bring its own ``writer``
        (names -> tables) that builds several tables in one job."""
        from ..session import materialize

        if self._writer is not None:
            tables = self._writer(names)
        else:
            tables = {n: materialize(getattr(self, n), f"graph-{n}") for n in names}
        args = {f: tables.get(f, self._src[f]) for f in self._FIELDS}
        return FraudGraph(**args)


def _seed(accounts: DataFrame, status: str, id_alias: str, name_alias: str | None = None) -> DataFrame:
    """P5: accounts with the given kyc_status, filtered before any hop."""
    cols = [F.col("account_id").alias(id_alias)]
    if name_alias:
        cols.append(F.col("customer_name").alias(name_alias))
    return accounts.filter(F.col("kyc_status") == F.lit(status)).select(*cols)


def hop(left: DataFrame, left_key: str, edges: DataFrame, edge_src: str,
        edge_dst: str, dst_alias: str) -> DataFrame:
    """Follow one edge from ``left[left_key]`` to ``edges[edge_dst]``."""
    e = edges.select(F.col(edge_src).alias("__src"), F.col(edge_dst).alias(dst_alias))
    return left.join(e, F.col(left_key) == F.col("__src"), "inner").drop("__src")


def _two_hop(seed: DataFrame, seed_key: str, edges: DataFrame, via: str,
             other_alias: str, distinct_endpoints: bool, back_edges: DataFrame | None = None) -> DataFrame:
    """seed -[e]-> node <-[e]- other: (seed, node, other) rows."""
    out = hop(seed, seed_key, edges, "account_id", via, via)
    back = (edges if back_edges is None else back_edges).select(F.col(via).alias("__via"), F.col("account_id").alias(other_alias))
    out = out.join(back, F.col(via) == F.col("__via"), "inner").drop("__via")
    if distinct_endpoints:
        out = out.filter(F.col(other_alias) != F.col(seed_key))
    return out


def ring_legs(g: FraudGraph, seeds: DataFrame, distinct_endpoints: bool,
              targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The two legs of G3/G4, both (fraud_id, suspicious_id, kind, node) with
    kind D (device) or A (address).

    Each fraud account starts from its lighter side: the kind whose nodes have
    fewer accounts around them in all. The first leg expands that side only. The
    second leg expands the other side too, unless looking up the nodes of that
    kind for each pair found takes fewer rows: a hub device or a mailbox
    address used by a third of all accounts is not expanded where there is a
    smaller way. Three tables are written: the nodes of the fraud accounts, the
    edges at these nodes (the edge tables are scanned twice in all) and the plan
    of each fraud account."""
    from ..session import materialize

    g = g.written("used_device", "shipped_to")  # each is read twice below
    same = dict(g.used_device.dtypes)["device_id"] == dict(g.shipped_to.dtypes)["address_id"]

    def of_kind(rows: DataFrame, kind: str, col: str, *more: str) -> DataFrame:
        node = F.col(col) if same else F.col(col).cast("string")
        return rows.select(*more, F.lit(kind).alias("kind"), node.alias("node"))

    edges = of_kind(g.used_device, "D", "device_id", "account_id").unionByName(of_kind(g.shipped_to, "A", "address_id", "account_id"))
    # Node existence: the pattern binds Account, Device and Address nodes.
    nodes = of_kind(g.devices, "D", "device_id").unionByName(of_kind(g.addresses, "A", "address_id"))
    known = g.accounts.select("account_id")
    if targets is not None:
        known = known.join(targets.select(F.col("suspicious_id").alias("account_id")), "account_id", "left_semi")
    own = (edges.join(seeds.select(F.col("fraud_id").alias("account_id")).distinct(), "account_id")
           .join(nodes, ["kind", "node"], "left_semi")
           .select(F.col("account_id").alias("fraud_id"), "kind", "node"))
    own = materialize(own, "ring-seed-nodes")
    near = (edges.join(own.select("kind", "node").distinct(), ["kind", "node"], "left_semi")
            .join(known, "account_id", "left_semi")
            .select(F.col("account_id").alias("suspicious_id"), "kind", "node"))
    near = materialize(near, "ring-near-edges")
    size = near.groupBy("kind", "node").agg(F.count(F.lit(1)).alias("n"))
    device, n = F.col("kind") == "D", F.col("n")
    work = (own.join(size, ["kind", "node"]).groupBy("fraud_id")
            .agg(F.sum(F.when(device, n)).alias("d"), F.sum(F.when(~device, n)).alias("a"),
                 F.count(F.when(device, n)).alias("n_d"), F.count(F.when(~device, n)).alias("n_a"))
            .filter("n_d > 0 and n_a > 0"))
    lookups = F.when(F.col("d") <= F.col("a"), F.col("d") * F.col("n_a")).otherwise(F.col("a") * F.col("n_d"))
    work = work.select("fraud_id", F.when(F.col("d") <= F.col("a"), "D").otherwise("A").alias("light"),
                       (lookups < F.greatest("d", "a")).alias("look_up"))
    own = materialize(own.join(work, "fraud_id").select("fraud_id", "kind", "node", (F.col("kind") == F.col("light")).alias("light"), "look_up"), "ring-plan")

    def expand(rows: DataFrame) -> DataFrame:
        out = rows.join(near, ["kind", "node"]).select("fraud_id", "suspicious_id", "kind", "node")
        return out.filter(F.col("suspicious_id") != F.col("fraud_id")) if distinct_endpoints else out

    first = expand(own.filter("light"))
    pairs = expand(own.filter("light and look_up")).select("fraud_id", "suspicious_id").distinct()
    looked_up = (pairs.join(own.filter("not light and look_up"), "fraud_id").join(near, ["suspicious_id", "kind", "node"])
                 .select("fraud_id", "suspicious_id", "kind", "node"))
    return first, expand(own.filter("not light and not look_up")).unionByName(looked_up)


def ring_matches(g: FraudGraph, seeds: DataFrame, distinct_endpoints: bool,
                 targets: DataFrame | None = None) -> DataFrame:
    """Core of G3/G4.

    ``seeds(fraud_id)`` are the fraud accounts. Returns one row per
    (suspicious_id, device_id, fraud_id, address_id) such that suspicious
    and fraud share the device and the address (bag semantics over the
    distinct edge keys). The legs come from ``ring_legs``: every fraud account
    expands its smaller neighbourhood; the other one is expanded or looked up for
    the pairs found, whichever takes fewer rows. ``targets(suspicious_id)`` restricts the other end before
    anything is expanded."""
    first, second = ring_legs(g, seeds, distinct_endpoints, targets)
    both = first.join(second.select("fraud_id", "suspicious_id", F.col("node").alias("other")), ["fraud_id", "suspicious_id"])
    from_device = F.col("kind") == "D"
    types = dict(g.devices.dtypes)["device_id"], dict(g.addresses.dtypes)["address_id"]
    return both.select("fraud_id", "suspicious_id",
                       F.when(from_device, F.col("node")).otherwise(F.col("other")).cast(types[0]).alias("device_id"),
                       F.when(from_device, F.col("other")).otherwise(F.col("node")).cast(types[1]).alias("address_id"))


def fraud_seeds(g: FraudGraph, status: str = CONFIRMED_FRAUD) -> DataFrame:
    """Account ids with the given kyc_status as ``fraud_id``."""
    return _seed(g.accounts, status, "fraud_id")


def syndicate_ring(g: FraudGraph, distinct_endpoints: bool = True,
                   fraud_status: str = CONFIRMED_FRAUD) -> DataFrame:
    """4-hop ring. Columns account_id, customer_name, device_id, full_address.

    ``customer_name`` is the confirmed fraudster's name, ``account_id`` the
    suspicious account. ``distinct_endpoints`` drops the self-match of a
    fraud account with itself (P10).
    """
    seeds = _seed(g.accounts, fraud_status, "fraud_id", "customer_name")
    ring = ring_matches(g, seeds.select("fraud_id"), distinct_endpoints)
    ring = ring.join(seeds, "fraud_id", "inner")
    ring = ring.join(g.addresses.select("address_id", "full_address"), "address_id", "inner")
    return ring.select(F.col("suspicious_id").alias("account_id"), "customer_name",
                       "device_id", "full_address")


def linked_fraud(g: FraudGraph, targets: DataFrame | None = None,
                 distinct_endpoints: bool = False,
                 fraud_status: str = CONFIRMED_FRAUD) -> DataFrame:
    """The ring anchored at target accounts.

    Columns target, linked_fraud_user, shared_device, drop_address.
    ``targets(account_id)`` restricts the anchor (P6); ``None`` anchors at
    every account. The investigated query keeps self-matches, so the default
    is ``distinct_endpoints=False``.
    """
    seeds = _seed(g.accounts, fraud_status, "fraud_id", "linked_fraud_user")
    ring = ring_matches(g, seeds.select("fraud_id"), distinct_endpoints,
                        None if targets is None else targets.select(F.col("account_id").alias("suspicious_id")))
    ring = ring.join(seeds, "fraud_id", "inner")
    ring = ring.join(g.addresses.select("address_id", "full_address"), "address_id", "inner")
    return ring.select(F.col("suspicious_id").alias("target"), "linked_fraud_user",
                       F.col("device_id").alias("shared_device"),
                       F.col("full_address").alias("drop_address"))


def device_fan_in(device_events: DataFrame, accounts: DataFrame, anchors: DataFrame | Column | object) -> DataFrame:
    """Every account that used an anchor device, with the edge's event.

    ``device_events(account_id, device_id, event_type, timestamp)`` holds the
    event-level USED_DEVICE rows; ``anchors`` is a DataFrame of device_id
    (left-semi join) or a single device id literal (P6 filter).
    Columns device_id, account_id, customer_name, event_type, timestamp.
    """
    if isinstance(anchors, DataFrame):
        ev = device_events.join(anchors.select("device_id").distinct(), "device_id", "left_semi")
    else:
        ev = device_events.filter(F.col("device_id") == F.lit(anchors))
    ev = ev.join(accounts.select("account_id", "customer_name"), "account_id", "inner")
    return ev.select("device_id", "account_id", "customer_name", "event_type", "timestamp")


def valid_transfers(g: FraudGraph) -> DataFrame:
    """TRANSFERRED edges whose two endpoints are Account nodes."""
    acc = g.accounts.select("account_id")
    t = g.transferred
    t = t.join(acc.withColumnRenamed("account_id", "src_account"), "src_account", "left_semi")
    return t.join(acc.withColumnRenamed("account_id", "dst_account"), "dst_account", "left_semi")


def transfer_paths(g: FraudGraph, lo: int = 1, hi: int = 3,
                   seed_status: str = VICTIM_COMPROMISED,
                   checkpoint_every: int = 1) -> DataFrame:
    """G6 + A3: walks of ``lo..hi`` TRANSFERRED edges from seed accounts.

    Walk semantics (nodes and edges may repeat). Instead of one row per walk,
    each hop carries the number of walks per (origin, node): parallel edges
    are pre-counted, the frontier is re-aggregated after every hop, so the
    frontier never exceeds (#origins x #reachable nodes) rows however many
    walks there are. Columns origin, destination, hop_count, n_paths; the
    per-walk bag is ``explode(sequence(1, n_paths))`` of it.

    Every ``checkpoint_every`` hops the frontier is written to the session's
    checkpoint folder, so a hop is computed once and not again by each later
    one (0: never).
    """
    if lo < 1 or hi < lo:
        raise ValueError("need 1 <= lo <= hi")
    from ..session import materialize, spread

    # Parallel edges pre-counted; written once, read by every hop.
    edges = materialize(valid_transfers(g)
                        .groupBy(F.col("src_account").alias("src"), F.col("dst_account").alias("dst"))
                        .agg(F.count(F.lit(1)).alias("n")), "transfer-edges")
    frontier = _seed(g.accounts, seed_status, "origin").select(
        "origin", F.col("origin").alias("node"), F.lit(1).cast("long").alias("paths"))
    results = []
    for h in range(1, hi + 1):
        frontier = (frontier.join(edges, frontier.node == edges.src, "inner")
                    .groupBy("origin", F.col("dst").alias("node"))
                    .agg(F.sum(F.col("paths") * F.col("n")).alias("paths")))
        if checkpoint_every and h % checkpoint_every == 0 and h < hi:
            frontier = materialize(frontier, f"paths-frontier-{h}")
            # a row becomes as many as its node has edges, about ten times as many here
            frontier = spread(frontier, 10 * frontier.count(), "node")
        if h >= lo:
            results.append(frontier.select(
                "origin", F.col("node").alias("destination"),
                F.lit(h).alias("hop_count"), F.col("paths").alias("n_paths")))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def expand_walks(paths: DataFrame) -> DataFrame:
    """One row per walk from ``transfer_paths`` output (the GQL bag form)."""
    step = 100_000  # no array is longer, however many walks a pair has
    return (paths.select("origin", "destination", "hop_count", "n_paths",
                         F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n_paths") - 1).cast("long"), F.lit(step).cast("long"))).alias("_from"))
            .select("origin", "destination", "hop_count",
                    F.explode(F.sequence(F.lit(1), F.least(F.lit(step), F.col("n_paths") - F.col("_from")).cast("int"))).alias("_i"))
            .drop("_i"))


def shared_device_pairs(g: FraudGraph, seeds: DataFrame, emulator_only: bool = True) -> DataFrame:
    """J2 (seeded): accounts sharing a device with a seed account.

    One row per (seed_account, linked_account) with the number of shared
    devices. Pairs are only formed from the seed side, never all pairs of a
    device's users; ``emulator_only`` applies P18 before the self-join.
    """
    ud = g.written("used_device").used_device.select("account_id", "device_id")
    if emulator_only:
        ud = ud.join(g.devices.filter(F.col("is_emulator")).select("device_id"), "device_id", "left_semi")
    s = seeds.select(F.col("account_id").alias("seed_account")).distinct()
    legs = _two_hop(s, "seed_account", ud, "device_id", "linked_account", True)
    return legs.groupBy("seed_account", "linked_account").agg(
        F.count(F.lit(1)).alias("shared_devices"))


def _device_links(g: FraudGraph, emulator_only: bool) -> DataFrame:
    ud = g.used_device.select("account_id", "device_id")
    if emulator_only:
        ud = ud.join(g.devices.filter(F.col("is_emulator")).select("device_id"), "device_id", "left_semi")
    return ud


def blast_radius(g: FraudGraph, emulator_only: bool = True) -> DataFrame:
    """How many accounts are tied to each device (who they are:
    ``blast_radius_members``).

    A device used by a third of all accounts still costs one partial
    aggregate per task: the distinct count shuffles on (device, account)
    first, then only per-task counts on device.
    """
    return _device_links(g, emulator_only).groupBy("device_id").agg(F.countDistinct("account_id").alias("n_accounts"))


def blast_radius_members(g: FraudGraph, emulator_only: bool = True, page_size: int = 1000) -> DataFrame:
    """The accounts tied to each device, in pages of about ``page_size``.

    Columns device_id, n_pages, page (from 0), members (sorted array). An
    account's page is a hash of its id modulo the device's number of pages, so
    a device used by a third of all accounts is many rows and many tasks, never
    one cell, and no order over all its accounts is needed. A page that no
    account hashes to is absent.
    """
    ud = _device_links(g.written("used_device"), emulator_only).filter(F.col("account_id").isNotNull()).distinct()
    pages = ud.groupBy("device_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(page_size)).cast("long").alias("n_pages"))
    slot = F.conv(F.substring(F.md5(F.col("account_id").cast("string")), 1, 8), 16, 10).cast("long")
    return (ud.join(pages, "device_id").withColumn("page", slot % F.col("n_pages"))
            .groupBy("device_id", "n_pages", "page").agg(F.array_sort(F.collect_list("account_id")).alias("members")))


def commercial_drop_links(g: FraudGraph) -> DataFrame:
    """Commercial drop addresses with the confirmed-fraud accounts that
    ship there; the address filter comes before the join."""
    drops = g.addresses.filter("is_commercial_drop").select("address_id", "full_address")
    fraud = fraud_seeds(g).select(F.col("fraud_id").alias("account_id"))
    return (g.shipped_to.select("account_id", "address_id").join(fraud, "account_id", "left_semi")
            .join(drops, "address_id", "inner").groupBy("address_id", "full_address")
            .agg(F.countDistinct("account_id").alias("n_fraud_accounts")))


def key_violations(df: DataFrame, key_cols: list[str], table_name: str) -> DataFrame:
    """Rows sharing a declared key (KEY clause not enforced by storage)."""
    key_text = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    return (df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1)
            .select(F.lit("duplicate_key").alias("violation"), F.lit(table_name).alias("table_name"),
                    key_text.alias("key_text"), "n_rows"))


def dangling_refs(edges: DataFrame, col: str, nodes: DataFrame, node_key: str,
                  table_name: str) -> DataFrame:
    """Edge rows whose reference has no node (REFERENCES clause)."""
    missing = edges.join(nodes.select(F.col(node_key).alias(col)), col, "left_anti")
    return (missing.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
            .select(F.lit(f"dangling_{col}").alias("violation"), F.lit(table_name).alias("table_name"),
                    F.col(col).cast("string").alias("key_text"), "n_rows"))


def graph_violations(checks: list[DataFrame]) -> DataFrame:
    """Union of key and reference checks, one row per offending key."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
