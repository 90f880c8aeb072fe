"""Spellings of one person or body, linked by a trie join.

1. Every distinct spelling is read into parts (names.py). Spellings that read the same form one node: surname (or town),
   given names (or kind of body), generation. A node whose given names are all written out is a person.
2. Trie join: surname keys are sharded by length (long shards further by hash) into tries; every key is
   run through the tries of its own and the neighbouring lengths by a Levenshtein automaton, which gives all keys within
   the distance without comparing it with each. Of two keys the less established may be the slip.
3. A node points to one other at most: a person with less said to the one person that says more (second given name,
   generation), a surname to the person of the same given names under the surname it may be a slip of, initials
   and abbreviations to the only person they can stand for, token order and titles having been read either way.
   Where several are possible, office or town decide, else there is no link.
4. Pointers are followed to their ends; spellings with the same end are one entity.

Nothing compares all names with each other: nodes meet by equal surname key and given name only. Defined cases: null
and blank names are left out; repeated names count once; relatives, other generations and other bodies of one town
have different given names, generations and kinds, and are never joined through a third node.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.llm import names as N
from missiva.sources.tables import cut

#: A key with more than RARE spellings, or of under 4 letters, is a slip only of one with WEIGHT times as many; distance of
#: folded keys; keys of a trie and queries against it.
RARE, WEIGHT, DISTANCE, SHARD, QUERIES = 2, 4, 2, 20_000, 400


class Trie:
    """Keys by their letters; the key ends where '' leads to it."""

    def __init__(self, keys):
        self.root: dict = {}
        for k in keys:
            node = self.root
            for c in k:
                node = node.setdefault(c, {})
            node[""] = k

    def within(self, word: str) -> list[tuple[str, int]]:
        """(key, distance) of all keys within DISTANCE, that is two, insertions, deletions, changes and transpositions of
        neighbours. The Levenshtein automaton is run bit-parallel: bit i of r0, r1 and r2 says that i letters of the word are
        matched with no, one and two errors. Branches on which no state is left are cut."""
        place: dict[str, int] = {}
        for i, c in enumerate(word):
            place[c] = place.get(c, 0) | (2 << i)
        goal, all_ = 1 << len(word), (2 << len(word)) - 1
        found = []
        # node, its states, those one letter before (a transposition begins there), and the places of the last letter
        stack = [(self.root, 1, 3 & all_, 7 & all_, 0, 0, 0)]
        while stack:
            node, r0, r1, r2, q0, q1, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    if r2 & goal:
                        found.append((child, 0 if r0 & goal else 1 if r1 & goal else 2))
                    continue
                b = place.get(c, 0)
                swap = (b << 1) & last
                n0 = (r0 << 1) & b
                n1 = (((r1 << 1) & b) | r0 | (r0 << 1) | (n0 << 1) | ((q0 << 2) & swap)) & all_
                n2 = (((r2 << 1) & b) | r1 | (r1 << 1) | (n1 << 1) | ((q1 << 2) & swap)) & all_
                if n2:
                    stack.append((child, n0, n1, n2, r0, r1, b))
        return found


def neighbours(asking: DataFrame, keys: DataFrame) -> DataFrame:
    """asking(s), keys(s): (s, t, distance) with t another key within DISTANCE."""
    sized = keys.select("s", F.length("s").alias("len"))
    counts = {r["len"]: r["count"] for r in sized.groupBy("len").count().collect()}  # a row for each length
    asked = {r["len"]: r["count"] for r in asking.groupBy(F.length("s").alias("len")).count().collect()}
    spark = keys.sparkSession
    plan = []
    for n, c in counts.items():
        shards = -(-c // SHARD)
        queries = max(1, -(-sum(asked.get(m, 0) for m in range(n - DISTANCE, n + DISTANCE + 1)) // QUERIES))
        plan.append((n, shards, queries))
    layout = F.broadcast(spark.createDataFrame(plan or [(0, 1, 1)], "len int, shards int, queries int"))  # a row for each length
    both = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    left = (
        asking.select("s", F.explode(F.sequence(F.length("s") - DISTANCE, F.length("s") + DISTANCE)).alias("len"))
        .join(layout, "len")
        .withColumn("block", F.pmod(F.xxhash64("s"), F.col("queries")).cast("int"))
        .withColumn("n", F.col("shards"))
        .select("s", "len", "block", both.alias("shard"))
    )
    right = (
        sized.join(layout, "len")
        .withColumn("shard", F.pmod(F.xxhash64("s"), F.col("shards")).cast("int"))
        .withColumn("n", F.col("queries"))
        .select("s", "len", "shard", both.alias("block"))
        .toDF("t", "t_len", "t_shard", "t_block")
    )

    def search(q: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(k["t"])
        rows = [(s, t, d) for s in q["s"] for t, d in trie.within(s) if t != s]
        return pd.DataFrame(rows, columns=["s", "t", "d"])

    # The keys are few bytes but much work, so the number of tasks is said here and not left to their size.
    tasks = 6 * spark.sparkContext.defaultParallelism
    left, right = left.repartition(tasks, "len", "shard", "block"), right.repartition(tasks, "t_len", "t_shard", "t_block")
    joined = left.groupBy("len", "shard", "block").cogroup(right.groupBy("t_len", "t_shard", "t_block"))
    return joined.applyInPandas(search, "s string, t string, d int")


PARSED = (
    "name string, s string, raw string, body boolean, g1 array<string>, g2 array<string>, full boolean, "
    "title string, gen string, office string, place string, initial string"
)
#: Initials written one for the other.
_ALIKE = ("cj", "ki")


def _initial(given: tuple[str, ...]) -> str:
    """The letter a first given name is short for, if there is no more of it."""
    plain = given[0].rstrip(".").lower() if given else ""
    return plain.translate(str.maketrans(*_ALIKE)) if len(plain) == 1 else ""


def parse(names: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["name"]:
                p = N.parse(text)
                if p is None:
                    continue
                if p.body:
                    rows.append((text, p.town, p.raw, True, [p.body], [], True, "", "", "", "", ""))
                    continue
                read = [list(N.given_readings(g)) for g in p.given]
                full = bool(read) and not any(map(N.is_short, p.given))
                rest = ["+".join(sorted(r)) for r in read[2:]]
                second = read[1] if len(read) > 1 else []
                if rest:
                    second = [" ".join([x, *rest]) for x in second]
                rows.append((text, p.surname, p.raw, False, read[0] if read else [], second, full, p.title, p.generation, p.office, p.place, _initial(p.given)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    return names.mapInPandas(run, PARSED)


def _decide(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Of candidates (keys, to, level, hint) the only one of the lowest level, or the only one with a hint."""
    low = cands.groupBy(*keys).agg(F.min("level").alias("level"))
    best = cands.join(low, [*keys, "level"]).groupBy(*keys, "to").agg(F.max("hint").alias("hint"))
    per = best.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("hint").alias("hints"), F.min("to").alias("only"), F.max(F.when(F.col("hint") > 0, F.col("to"))).alias("hinted")
    )
    to = F.when(F.col("n") == 1, F.col("only")).when(F.col("hints") == 1, F.col("hinted"))
    return per.select(*keys, to.alias("to")).filter(F.col("to").isNotNull())


def _follow(pointers: DataFrame) -> DataFrame:
    """(node, to) to (node, end): each round doubles the way covered; pointers go from less to more, so none circle."""
    while True:
        nxt = pointers.select(F.col("node").alias("to"), F.col("to").alias("further"))
        pairs = cut(pointers.select("node", "to").join(nxt, "to", "left"))
        if pairs.filter("further IS NOT NULL").isEmpty():
            return pairs.select("node", F.col("to").alias("end"))
        pointers = pairs.select("node", F.coalesce("further", "to").alias("to"))


def entities(names: DataFrame) -> DataFrame:
    """names(name), distinct: (name, entity)."""
    spark = names.sparkSession
    parsed = parse(names)
    joined = lambda c: F.array_join(F.array_sort(c), "/")
    node = F.concat_ws(
        "|", "s", joined("g1"), joined("g2"), "gen", F.when(F.col("body"), "b"), F.when(~F.col("full"), F.concat_ws("|", "title", "office", "place", "initial"))
    )
    parsed = cut(parsed.withColumn("node", node))
    nodes = cut(
        parsed.groupBy("node", "s", "body", "g1", "g2", "full", "gen", F.when(~F.col("full"), F.col("initial")).otherwise("").alias("initial")).agg(
            F.count("*").alias("spellings"),
            F.min("raw").alias("raw"),
            F.min("title").alias("title"),  # empty if one spelling has none
            F.max("office").alias("office"),
            F.max("place").alias("place"),
        )
    )
    # How established a key is: spellings of it, and for towns also those that name it as a place.
    places = parsed.filter("place <> ''").select(F.col("place").alias("s"), F.lit(1).alias("k"))
    counted = nodes.select("s", F.col("spellings").alias("k")).unionByName(places).groupBy("s").agg(F.sum("k").alias("known"))
    keys = cut(nodes.select("s").distinct().join(counted, "s"))
    near = neighbours(keys.select("s"), keys.select("s"))
    size = keys.select("s", "known")
    heavier = (F.col("t_known") > F.col("known")) | ((F.col("t_known") == F.col("known")) & (F.col("t") < F.col("s")))
    near = (
        near.join(size, "s")
        .join(size.toDF("t", "t_known"), "t")
        .filter(F.when((F.col("known") <= RARE) & (F.length("s") >= 4), heavier).otherwise(F.col("t_known") >= WEIGHT * F.col("known")))
        .select("s", "t", "d")
    )
    near = cut(near)

    people = nodes.filter("full").select(
        F.col("node").alias("to"),
        F.col("s").alias("p_s"),
        F.col("body").alias("p_body"),
        F.col("g1")[0].alias("p_g1"),
        F.when(F.size("g2") > 0, F.col("g2")[0]).alias("p_g2"),
        F.col("gen").alias("p_gen"),
        F.col("raw").alias("p_raw"),
        F.col("office").alias("p_office"),
        F.col("place").alias("p_place"),
    )
    # Where a node's surname may be found: under its own key, or a neighbouring one if both are close as folded or as typed.
    own = nodes.withColumn("t", F.col("s")).withColumn("d", F.lit(0))
    slip = nodes.join(near, "s")
    placed = own.unionByName(slip.select(*own.columns))
    second_fits = (F.size("g2") == 0) | F.array_contains("g2", F.col("p_g2"))
    letters_of = lambda c: F.array_sort(F.split(c, ""))
    swapped = (F.length("raw") == F.length("p_raw")) & (F.levenshtein("raw", "p_raw", 2) >= 0) & (letters_of("raw") == letters_of("p_raw"))
    close = (F.col("d") <= 1) | (F.levenshtein("raw", "p_raw", 1) >= 0) | swapped
    same_gen = F.col("gen") == F.col("p_gen")
    no_gen = (F.col("gen") == "") & (F.col("p_gen") != "")

    full = placed.filter("full").withColumn("first", F.col("g1")[0])
    on = (F.col("t") == F.col("p_s")) & (F.col("first") == F.col("p_g1")) & (F.col("body") == F.col("p_body"))
    equal_second = F.coalesce(F.when(F.size("g2") > 0, F.col("g2")[0]), F.lit("")) == F.coalesce("p_g2", F.lit(""))
    says_more = ((F.size("g2") == 0) & F.col("p_g2").isNotNull() & (same_gen | no_gen)) | (equal_second & no_gen)
    up = full.join(people, on).filter(
        (F.col("node") != F.col("to"))
        & F.when(F.col("d") == 0, says_more).otherwise(close & ((equal_second & same_gen) | says_more))
    )
    level = F.when(F.col("d") == 0, F.when(equal_second | same_gen, 2).otherwise(3)).otherwise(F.when(equal_second & same_gen, 0).otherwise(1) + F.col("d") * 4)
    equal = lambda c: (F.col(c) != "") & (F.col(c) == F.col(f"p_{c}"))
    full_points = cut(_decide(up.select("node", "to", level.alias("level"), (equal("office") | equal("place")).cast("int").alias("hint")), ["node"]))
    # Titled only: M. Heinrich X may be M(argarethe) Heinrich X, if there is no other.
    letters = spark.createDataFrame([(t.upper(), r) for t in N.UNSURE_TITLES for r in N.given_readings(t + ".")], "title string, first string")
    titled = (
        nodes.filter("title <> '' AND NOT body AND size(g2) = 0")
        .join(F.broadcast(letters), "title")  # two titles with the given names of their letter
        .withColumn("g2", F.col("g1"))
        .withColumn("t", F.col("s"))
        .select(*nodes.columns, "first", "t")
    )
    twofold = titled.join(people, on).filter((F.col("node") != F.col("to")) & F.array_contains("g2", F.col("p_g2")) & (same_gen | no_gen))
    spare = twofold.filter("full").join(full_points, "node", "left_anti")
    full_points = cut(full_points.unionByName(_decide(spare.select("node", "to", F.lit(0).alias("level"), F.lit(0).alias("hint")), ["node"])))
    ends = _follow(full_points)
    people_end = people.join(ends.select(F.col("node").alias("to"), "end"), "to", "left").withColumn("end", F.coalesce("end", "to"))

    # Initials and abbreviations: the ends of the persons they can stand for have to be one.
    hints = parsed.filter("full AND NOT body").select(F.col("node").alias("to"), F.explode(F.array("office", "place")).alias("hint")).filter("hint <> ''")
    hints = hints.join(people_end.select("to", "end"), "to").select(F.col("end").alias("h_end"), F.col("hint").alias("h_word")).distinct()
    # Last of all a short one may mean the person of a slip of its own surname.
    back = nodes.filter("NOT full AND NOT body").join(near.select(F.col("t").alias("s"), F.col("s").alias("t"), "d"), "s").select(*own.columns)
    short = placed.withColumn("last", F.lit(0)).unionByName(back.withColumn("last", F.lit(1))).filter("NOT full AND NOT body").withColumn("first", F.explode("g1"))
    straight = short.join(people_end, on).filter(second_fits & (same_gen | no_gen) & close)
    other = twofold.filter("NOT full").join(ends.select(F.col("node").alias("to"), "end"), "to", "left").withColumn("end", F.coalesce("end", "to"))
    other_letter = (F.col("initial") != "") & (F.translate(F.lower(F.substring("p_g1", 1, 1)), *_ALIKE) != F.col("initial"))
    level = F.col("last") * 16 + F.col("d") * 4 + F.when(other_letter, 2).otherwise(0) + F.when(same_gen, 0).otherwise(1)
    cands = straight.select("node", "end", level.alias("level"), "office", "place").unionByName(
        other.select("node", "end", F.lit(0).alias("level"), "office", "place")
    )
    cands = cut(cands.distinct())
    hinted = (
        cands.select("node", "end", F.explode(F.array("office", "place")).alias("h_word"))
        .filter("h_word <> ''")
        .join(hints, "h_word")
        .filter("end = h_end")
        .select("node", "end", F.lit(1).alias("hint"))
        .distinct()
    )
    cands = cands.join(hinted, ["node", "end"], "left").select("node", F.col("end").alias("to"), "level", F.coalesce("hint", F.lit(0)).alias("hint"))
    short_points = _decide(cands, ["node"]).withColumnRenamed("to", "end")
    all_ends = ends.select("node", "end").unionByName(short_points.select("node", "end"))
    return parsed.join(all_ends, "node", "left").select("name", F.coalesce("end", "node").alias("entity"))


def pairs(found: DataFrame) -> DataFrame:
    """(name_a, name_b) of each two spellings of one entity; the problem asks for the pairs themselves."""
    found = cut(found)  # else both sides would work it out
    a, b = found.toDF("name_a", "entity"), found.toDF("name_b", "entity")
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")
