"""The k most similar vectors of every vector, by randomly rotated one-bit codes.

A unit vector is padded into about LENGTH dimensions by a random rotation and kept as its signs, packed, with one
correction scalar, the inner product of the vector with its own code. Two packed codes are compared by XOR and bit
count: the share of differing signs estimates the angle, within BOUND standard deviations. What that leaves is
estimated again from the one code, its scalar and the exact other vector, whose error shrinks with the root of the
code's length, and then from bytes; only what can still reach the k best is fetched and reranked exactly.

1. Exact copies form one class; a class takes part once, by its smallest key, with its k + 1 smallest keys as members.
   So a vector that a third of the rows share is one vector here, and is expanded at the end only, k pairs a row.
2. Cells of about CELL classes, in proportion to their number, by centroids on two levels: at most TOP coarse ones, fitted
   on a bounded sample on the driver and broadcast; and in each coarse cell as many fine ones as its size asks for,
   fitted by a task on a bounded sample of it and joined by key, never collected. Every class is in one cell. A cell
   beyond PIECE classes is cut by a hash into pieces, all of which are searched by whoever searches the cell.
3. At home each class is compared exactly with its own piece; that gives the similarity others have to beat.
4. Each class visits the nearest fine cells of its nearest coarse ones, len(VISITS) coarse and sum(VISITS) fine cells at
   most, whatever the number of classes. Its code, scalar, similarity to beat and a vector of rounded bytes travel.
5. What may be better is sent back by key; the vectors of what can still be among the k best are fetched
   and compared exactly.

Work and shuffled bytes for each vector are thus constant. Ties go to the smaller key. Defined cases: null, zero,
non-finite and wrongly sized vectors are left out; a repeated key counts once, in its latest row; an empty table gives
no row; with fewer than k others all of them count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missiva.sources.tables import cut, latest

#: Classes of a cell; of a piece at most; coarse cells at most; fine cells in a coarse one at most.
CELL, PIECE, TOP, FINE = 512, 4_096, 1_024, 1_024
#: Fine cells visited in the nearest coarse cell, the next, and so on; a coarse cell that isn't divided has one.
VISITS = (5, 3, 2, 2, 1, 1, 1, 1)
#: Sampled classes for each centroid, and bytes of a sample; bits of a code at least; standard deviations of the bounds.
PER_CENTROID, SAMPLE_BYTES, LENGTH, BOUND = 32, 1 << 26, 256, 3.0
#: Classes of one task where rows meet the centroids of their coarse cell or the vectors to be compared exactly.
SALT = 16_384
#: Cells of several pieces that are broadcast at most (12 bytes each).
LISTED = 65_536
SEED = 20_260
#: Rows of one step of bit counts: 256 x 512 words are 1 MB.
STEP = 256


def bits(dim: int) -> int:
    return dim * -(-LENGTH // dim)


@cache
def rotation(dim: int) -> np.ndarray:
    """dim orthonormal rows of length bits(dim), the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits(dim), bits(dim))))
    return (q * np.sign(np.diag(r)))[:dim].astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of tiny or huge values leave the range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs packed into words, correction) of unit vectors."""
    r = x.astype(np.float32) @ rotation(x.shape[1])
    packed = np.packbits(r > 0, axis=1)
    words = np.zeros((len(x), -(-packed.shape[1] // 8) * 8), np.uint8)
    words[:, : packed.shape[1]] = packed
    return words.view(np.uint64), (np.abs(r).sum(1) / np.sqrt(r.shape[1])).astype(np.float32)


def signs(words: np.ndarray, length: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, count=length).astype(np.float32) * 2 - 1


@cache
def reach(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest and lowest similarity that so many differing signs admit."""
    share = np.arange(length + 1) / length
    off = BOUND * np.sqrt(np.maximum(share * (1 - share), 1 / length) / length)
    return np.cos(np.pi * np.clip(share - off, 0, 1)), np.cos(np.pi * np.clip(share + off, 0, 1))


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means over unit vectors; an empty centroid stays where it was."""
    sample = sample.astype(np.float32)
    c = sample[np.random.default_rng(SEED).choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(8):
        near = np.concatenate([(sample[i : i + 8_192] @ c.T).argmax(1) for i in range(0, len(sample), 8_192)])
        order = np.argsort(near, kind="stable")
        own, at = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(sample[order], at, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c[own] = np.where(norm > 0, sums / np.maximum(norm, 1e-30), c[own])
    return c


def _stack(values: pd.Series, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _best(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest of each row, highest first."""
    k = min(k, sim.shape[1])
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable"), 1)


def at_home(keys: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, list, list]:
    """(what each class has to beat, its best others, their similarities) within one piece."""
    beat, others, sims = np.full(len(keys), -2.0), [], []
    for lo in range(0, len(keys), STEP):
        s = np.round(x[lo : lo + STEP] @ x.T, 12)
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -3
        edge = min(k, len(keys) - 1)
        least = np.partition(s, -edge, axis=1)[:, -edge] if edge else np.full(len(s), 9.0)
        for i, row in enumerate(s):
            j = np.flatnonzero(row >= least[i])  # all ties, of which the smaller keys count
            j = j[np.lexsort((keys[j], -row[j]))][:k]
            others.append(keys[j])
            sims.append(row[j])
            if len(j) == k:
                beat[lo + i] = row[j[-1]]
    return beat, others, sims


class Visitors:
    """What travels of a class: code, scalar, the similarity to beat, and its vector rounded to bytes for a second look."""

    COLUMNS = ("rep", "code", "own", "beat", "rough", "scale", "err")
    SCHEMA = "rep bigint, code binary, own float, beat double, rough binary, scale float, err float"

    def __init__(self, rows: pd.DataFrame):
        self.words = _stack(rows["code"], np.uint64)
        self.own, self.beat = rows["own"].to_numpy(np.float32), rows["beat"].to_numpy(np.float64)
        self.x = _stack(rows["rough"], np.int8).astype(np.float32) * rows["scale"].to_numpy(np.float32)[:, None]
        self.err = rows["err"].to_numpy(np.float32) + 1e-6

    @staticmethod
    def of(x: np.ndarray) -> dict[str, list]:
        words, own = encode(x)
        scale = np.abs(x).max(1) / 127
        rough = np.rint(x / scale[:, None]).astype(np.int8)
        err = np.linalg.norm(x - rough * scale[:, None], axis=1)  # no inner product with a unit vector is further off
        return {"code": [w.tobytes() for w in words], "own": own, "rough": [r.tobytes() for r in rough], "scale": scale.astype(np.float32), "err": err.astype(np.float32)}


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a with rows j of b; of all rows at once where many are wanted."""
    if len(i) > len(a) * len(b) // 50:
        return (a @ b.T)[i, j]
    return np.concatenate([np.empty(0, np.float32), *(np.einsum("ij,ij->i", a[i[p : p + 65_536]], b[j[p : p + 65_536]]) for p in range(0, len(i), 65_536))])


def visit(v: Visitors, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Visitors and the unit vectors of a piece: (visitor, vector, similarity up to the visitor's err), by position, of all
    that may be among the visitor's k best."""
    length = bits(x.shape[1])
    high, low = reach(length)
    theirs, _ = encode(x)
    exact = x.astype(np.float32)
    turned = exact @ rotation(x.shape[1])
    spread = (BOUND * np.sqrt(np.maximum(0, 1 - v.own**2)) / v.own / np.sqrt(length - 1)).astype(np.float32)
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0, np.float32))]
    for lo in range(0, len(v.words), STEP):
        w, b = v.words[lo : lo + STEP], v.beat[lo : lo + STEP].copy()
        differ = np.zeros((len(w), len(x)), np.uint16)
        for n in range(w.shape[1]):
            differ += np.bitwise_count(w[:, n, None] ^ theirs[None, :, n])
        if len(x) >= k:  # the k-th best of this piece is at least that good
            b = np.maximum(b, low[np.partition(differ, k - 1, axis=1)[:, k - 1]])
        # high falls with the number of differing signs, so what may reach b differs in at most so many
        most = np.searchsorted(-high, -(b - 1e-9), "right") - 1
        i, j = np.nonzero(differ <= most[:, None])
        estimate = _dots(signs(w, length), turned, i, j) / (np.sqrt(length) * v.own[lo + i])
        keep = estimate + spread[lo + i] >= b[i] - 1e-6
        i, j = i[keep], j[keep]
        sim, err = _dots(v.x[lo : lo + STEP], exact, i, j), v.err[lo + i]
        keep = sim + err >= b[i]
        i, j, sim, err = i[keep], j[keep], sim[keep], err[keep]
        order = np.lexsort((-sim, i))
        i, j, sim, err = i[order], j[order], sim[order], err[order]
        # What is surely behind k others of this piece falls out.
        kth = np.searchsorted(i, i) + k - 1
        full = kth < np.searchsorted(i, i, "right")
        keep = ~full | (sim + 2 * err >= sim[np.minimum(kth, max(len(i) - 1, 0))]) if len(i) else full
        found.append((lo + i[keep], j[keep], sim[keep]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _clean(df: DataFrame, key: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    sized = F.col("embedding").isNotNull() & (F.size("embedding") == F.col("dim")) & (F.col("dim") > 0)
    rows = df.filter(F.col(key).isNotNull() & sized).filter(finite & some)
    newest = latest(rows.select(F.col(key).alias("key"), "dim", "embedding", "updated_at"), ["key"], [F.col("updated_at").desc_nulls_last()])
    # Two hashes of the values name a class of exact copies.
    return newest.select("key", "dim", "embedding", F.xxhash64("embedding", "dim").alias("h1"), F.hash("embedding").alias("h2"))


def nearest(df: DataFrame, key: str = "vec_no", k: int = 5) -> DataFrame:
    """df(key, dim, embedding, updated_at) -> (vec_a, vec_b), distinct, vec_a < vec_b: pairs of which one is among the
    k most similar by cosine of the other. Vectors of different length never meet."""
    spark = df.sparkSession
    rows = cut(_clean(df, key))
    dims = [r["dim"] for r in rows.select("dim").distinct().collect()]  # lengths of vectors, a handful
    found = [_nearest(rows.filter(F.col("dim") == d), d, k) for d in sorted(dims)]
    if not found:
        return spark.createDataFrame([], "vec_a bigint, vec_b bigint")
    result = found[0]
    for f in found[1:]:
        result = result.unionByName(f)
    return result


def _meet(left: DataFrame, right: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """Groups of both sides by key, run together; the right side's columns are renamed, as both may have one origin."""
    right = right.toDF(*(f"r_{c}" for c in right.columns))
    return left.groupBy(*keys).cogroup(right.groupBy(*(f"r_{k}" for k in keys))).applyInPandas(run, schema)


def _coarse(classes: DataFrame, n: int, dim: int) -> np.ndarray:
    """Coarse centroids, from a bounded sample by hash."""
    cells = max(1, min(TOP, n // CELL))
    size = max(1, min(n, cells * PER_CENTROID * 4, SAMPLE_BYTES // (4 * dim)))
    share = min(1.0, 1.2 * size / max(n, 1))
    picked = classes.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("raw").limit(size).collect()
    return centroids(unit(_stack([bytes(r["raw"]) for r in picked])), cells)


def _fine(placed: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """(coarse, fine centroids as bytes) of the coarse cells that are divided; plan has (coarse, classes, fine cells)."""
    spark = placed.sparkSession
    rows = [(c, f, min(1.0, f * PER_CENTROID / m)) for c, m, f in plan]
    wanted = F.broadcast(spark.createDataFrame(rows, "coarse int, fine int, share double"))  # at most TOP rows
    chosen = placed.select("raw", "rep", F.col("near")[0].alias("coarse")).join(wanted, "coarse")
    chosen = chosen.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < F.col("share") * (1 << 20) + 1)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        c = centroids(unit(_stack(group["raw"])), int(group["fine"].iloc[0]))
        return pd.DataFrame([(int(group["coarse"].iloc[0]), c.tobytes())], columns=["coarse", "middle"])

    return chosen.select("coarse", "fine", "raw").groupBy("coarse").applyInPandas(fit, "coarse int, middle binary")


def _choose(rows: DataFrame, fine: DataFrame, plan: list[tuple[int, int, int]], dim: int, schema: str, pick) -> DataFrame:
    """Rows meet the fine centroids of their coarse cell, as many tasks to a cell as its rows ask for. A cell of whose
    classes none was sampled stays one fine cell."""
    spark = rows.sparkSession
    salts = F.broadcast(spark.createDataFrame([(c, -(-m // SALT)) for c, m, _ in plan], "coarse int, salts int"))  # at most TOP rows
    left = rows.join(salts, "coarse").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")).drop("salts")
    right = fine.join(salts, "coarse").select("coarse", "middle", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        return pick(a, np.frombuffer(b["r_middle"].iloc[0], np.float32) if len(b) else np.zeros(dim, np.float32))

    return _meet(left, right, ["coarse", "salt"], run, schema)


def _nearest(rows: DataFrame, dim: int, k: int) -> DataFrame:
    spark = rows.sparkSession
    sc = spark.sparkContext
    first = Window.partitionBy("h1", "h2").orderBy("key")
    heads = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    classes = heads.groupBy("h1", "h2").agg(
        F.min("key").alias("rep"), F.sort_array(F.collect_list("key")).alias("members"), F.min_by("embedding", "key").alias("embedding")
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["raw"] = [np.asarray(v, np.float32).tobytes() for v in b.pop("embedding")]
            yield b

    classes = cut(classes.mapInPandas(pack, "h1 bigint, h2 int, rep bigint, members array<bigint>, raw binary"))
    n = classes.count()
    middle = sc.broadcast(_coarse(classes, n, dim))  # at most TOP rows
    # Unlike fine cells, a coarse cell is chosen by the exact vector, as it is here.

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = unit(_stack(b["raw"])).astype(np.float32)
                b["near"] = list(_best(x @ middle.value.T, len(VISITS)).astype(np.int32))
                yield b

    placed = cut(classes.select("rep", "raw").mapInPandas(assign, "rep bigint, raw binary, near array<int>"))
    sizes = placed.groupBy(F.col("near")[0].alias("coarse")).count().collect()  # at most TOP rows
    plan = [(r["coarse"], r["count"], min(FINE, -(-r["count"] // (2 * CELL)) * 2)) for r in sizes if r["count"] > 2 * CELL]
    divided = F.col("coarse").isin([c for c, *_ in plan]) if plan else F.lit(False)
    fine = cut(_fine(placed, plan)) if plan else None
    number = lambda c: F.col(c).cast("bigint") * FINE

    def settle(a: pd.DataFrame, flat: np.ndarray) -> pd.DataFrame:
        x = unit(_stack(a["raw"])).astype(np.float32)
        a["cell"] = a["coarse"].astype(np.int64) * FINE + (x @ flat.reshape(-1, dim).T).argmax(1)
        return a[["rep", "raw", "near", "cell"]]

    coarse = placed.withColumn("coarse", F.col("near")[0])
    homes = coarse.filter(~divided).select("rep", "raw", "near", number("coarse").alias("cell"))
    if plan:
        homes = homes.unionByName(_choose(coarse.filter(divided), fine, plan, dim, "rep bigint, raw binary, near array<int>, cell bigint", settle))
    homes = cut(homes)
    # Pieces of the cells that have more than one: at most a row for each PIECE classes.
    large = cut(homes.groupBy("cell").count().filter(F.col("count") > PIECE).select("cell", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces")))
    count = large.count()

    def cut_up(rows: DataFrame) -> DataFrame:
        """Adds pieces, null for cells of one; usually there are no others, and a short list of them is broadcast."""
        if not count:
            return rows.withColumn("pieces", F.lit(None).cast("int"))
        return rows.join(F.broadcast(large) if count <= LISTED else large, "cell", "left")

    homes = cut_up(homes).withColumn("piece", F.pmod(F.xxhash64("rep"), F.coalesce("pieces", F.lit(1))).cast("int"))

    def home(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep").reset_index(drop=True)
        x = unit(_stack(group["raw"]))
        group["beat"], group["others"], group["sims"] = at_home(group["rep"].to_numpy(np.int64), x, k)
        return group.assign(**Visitors.of(x))[[*travelling, "raw", "near", "cell", "piece", "others", "sims"]]

    travelling = list(Visitors.COLUMNS)
    schema = Visitors.SCHEMA + ", raw binary, near array<int>, cell bigint, piece int, others array<bigint>, sims array<double>"
    settled = cut(homes.select("rep", "raw", "near", "cell", "piece").groupBy("cell", "piece").applyInPandas(home, schema))

    going = settled.select(*travelling, F.col("cell").alias("from_cell"), F.col("piece").alias("from_piece"), F.posexplode("near").alias("turn", "coarse"))

    def tour(a: pd.DataFrame, flat: np.ndarray) -> pd.DataFrame:
        c = flat.reshape(-1, dim)
        length = bits(dim)
        turned = (c @ rotation(dim)).T
        out = []
        for lo in range(0, len(a), STEP * 4):
            part = a.iloc[lo : lo + STEP * 4]
            order = _best(signs(_stack(part["code"], np.uint64), length) @ turned, max(VISITS))
            for t, rows in part.reset_index(drop=True).groupby("turn"):
                for v in range(min(VISITS[t], order.shape[1])):
                    out.append(rows.assign(cell=rows["coarse"].astype(np.int64) * FINE + order[rows.index, v]))
        return pd.concat(out, ignore_index=True)[[*travelling, "from_cell", "from_piece", "cell"]]

    visits = going.filter(~divided).select(*travelling, "from_cell", "from_piece", number("coarse").alias("cell"))
    if plan:
        # A coarse cell is visited by more classes than it has; tasks are planned for all of them.
        crowd = [(c, m * len(VISITS), f) for c, m, f in plan]
        schema = Visitors.SCHEMA + ", from_cell bigint, from_piece int, cell bigint"
        visits = visits.unionByName(_choose(going.filter(divided), fine, crowd, dim, schema, tour))
    visits = cut_up(visits).withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
    visits = visits.filter((F.col("cell") != F.col("from_cell")) | (F.col("piece") != F.col("from_piece")))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["rep", "other", "sim", "err"])
        v = Visitors(a)
        i, j, sim = visit(v, unit(_stack(b["r_raw"])), k)
        return pd.DataFrame({"rep": a["rep"].to_numpy()[i], "other": b["r_rep"].to_numpy()[j], "sim": sim, "err": v.err[i]})

    stay = settled.select("cell", "piece", "rep", "raw")
    back = _meet(visits.select(*travelling, "cell", "piece"), stay, ["cell", "piece"], compare, "rep bigint, other bigint, sim float, err float")
    # Of what all visits brought, what is surely behind k others falls out; the vectors of the rest are fetched.
    ranked = Window.partitionBy("rep").orderBy(F.col("sim").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = back.withColumn("kth", F.nth_value("sim", k).over(ranked)).filter(F.col("kth").isNull() | (F.col("sim") + 2 * F.col("err") >= F.col("kth")))
    back = back.select("rep", "other").join(settled.select(F.col("rep").alias("other"), "raw"), "other")

    groups = max(1, -(-n // SALT))
    bucket = F.pmod(F.xxhash64("rep"), F.lit(groups)).cast("int").alias("bucket")

    def rerank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        keys = a["rep"].to_numpy(np.int64)
        x = unit(_stack(a["raw"]))
        order = np.argsort(keys)
        parts = [
            (np.repeat(keys, a["others"].map(len)), np.concatenate(a["others"].tolist()), np.concatenate(a["sims"].tolist())),
        ]
        for lo in range(0, len(b), 32_768):
            part = b.iloc[lo : lo + 32_768]
            at = order[np.searchsorted(keys[order], part["r_rep"].to_numpy(np.int64))]
            parts.append((keys[at], part["r_other"].to_numpy(np.int64), np.round((x[at] * unit(_stack(part["r_raw"]))).sum(1), 12)))
        key, other, sim = (np.concatenate(c) for c in zip(*parts))
        o = np.lexsort((other, -sim, key))
        key, other, sim = key[o], other[o], sim[o]
        top = np.arange(len(key)) - np.searchsorted(key, key) < k
        return pd.DataFrame({"key": key[top], "other": other[top], "sim": sim[top]})

    own = settled.select(bucket, "rep", "raw", "others", "sims")
    best = _meet(own, back.select(bucket, "rep", "other", "raw"), ["bucket"], rerank, "key bigint, other bigint, sim double")

    members = classes.select("rep", "members", "h1", "h2")
    listed = lambda sim, keys: F.transform(keys, lambda m: F.struct((-sim).alias("far"), m.alias("m")))
    others = (
        best.join(members.select(F.col("rep").alias("other"), "members"), "other")
        .groupBy("key")
        .agg(F.flatten(F.collect_list(listed(F.col("sim"), F.col("members")))).alias("o"))  # at most k x (k + 1)
    )
    none = F.array().cast("array<struct<far:double,m:bigint>>")
    every = F.concat(listed(F.lit(1.0), F.col("members")), F.coalesce("o", none))
    ranked = (
        members.join(others.withColumnRenamed("key", "rep"), "rep", "left")
        .select("h1", "h2", F.slice(F.transform(F.array_sort(every), lambda s: s["m"]), 1, k + 1).alias("top"))
    )
    pairs = rows.join(ranked, ["h1", "h2"]).select("key", F.explode(F.slice(F.filter("top", lambda m: m != F.col("key")), 1, k)).alias("m"))
    return pairs.select(F.least("key", "m").alias("vec_a"), F.greatest("key", "m").alias("vec_b")).distinct()
