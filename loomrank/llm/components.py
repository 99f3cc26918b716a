"""Links between sets through inverted lists, and distributed union-find (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import beside, done, once, one_each, small, staged

#: Members of a family that meet each other directly, and members whose majority is the reference of a larger family.
FEW, SAMPLE = 8, 32
#: Bits that stand for a difference while pairs are sought.
PARITY = 1024
#: Members of one block when a list is compared member by member, and turns in which the members of a family's lists meet one centre each before.
BLOCK, STARS = 256, 4
#: Keys up to which they are sent to every task. Low, so that tables of a tenth of a GB and of many take the same plan; as a hash relation a million take some 67 MB in the driver, and several are built at once.
NARROW = 20_000
#: A filter of keys has up to GROUPS rows of WORDS longs, a bit for each key: 8 MB, however many keys there are.
GROUPS, WORDS = 1 << 16, 16
#: Rounds of hubs before what is left of the lists is compared block by block.
ROUNDS = 3
#: Percent by which an estimate may lie below the threshold for a family, and a similarity for a member that needs no other list.
ROOM, CORE = 45, 15


def components(links: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of ``links(a, b)``: one row (id, comp) for each linked id, comp the smallest id reachable.

    Min-label hooking and pointer jumping: each round an edge joins the labels of its ends, the larger
    root hooks below the smallest neighbour label, and labels then jump to their label's label. Labels
    only fall, and a long path halves each round, so rounds grow with the logarithm of the longest path.
    Every aggregate has a map-side part and every join is a plain equi-join, which adaptive execution
    splits where one label is hot. Nulls in ``links`` are ignored; an empty table gives an empty result.
    """
    pairs = links.where("a is not null and b is not null and a <> b")
    edges = staged(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct(), f"{label}-edges")
    state = staged(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), f"{label}-0")
    round_ = 0
    while True:
        round_ += 1
        near = edges.join(state.select(F.col("id").alias("b"), F.col("comp").alias("seen")), "b").groupBy(F.col("a").alias("id")).agg(F.min("seen").alias("seen"))
        hooked = staged(state.select("id", "comp").join(near, "id", "left").select("id", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp")), f"{label}-{round_}h")
        # an old root learns the smallest label that any of its members saw
        roots = hooked.groupBy(F.col("old").alias("root")).agg(F.min("comp").alias("low"))
        moved = staged(hooked.join(roots, hooked["old"] == roots["root"], "left").select("id", "old", F.least("comp", "low").alias("comp")), f"{label}-{round_}a")
        jump = moved.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        now = staged(moved.join(jump, "comp", "left").select("id", "old", F.coalesce("up", "comp").alias("comp")), f"{label}-{round_}b")
        done(state, hooked, moved)
        state = now
        if state.where("comp <> old").isEmpty():
            done(edges)
            return state.select("id", "comp")


def close(x: str, y: str, k: int, percent: int) -> Column:
    """Whether, of the ``k`` smallest values of the union of two bottom-k sketches, both hold ``percent``/100 at least. All that they share bounds it from above and is looked at first. As lambdas, since the code that Spark makes of the plain columns is too long for the JVM to compile."""
    a, b = F.col(x), F.col(y)
    low = F.slice(F.sort_array(F.array_union(a, b)), 1, k)

    def enough(shared: Column) -> Column:
        sure = once(low, lambda low: 100 * F.size(F.array_intersect(low, shared)) >= percent * F.size(low))
        return F.when(100 * F.size(shared) < percent * F.least(F.greatest(F.size(a), F.size(b)), F.lit(k)), F.lit(False)).otherwise(sure)

    return once(F.array_intersect(a, b), enough)


def fits(n: Column, m: Column, apart: Column, percent: int) -> Column:
    """Whether sets of ``n`` and ``m`` elements whose symmetric difference has ``apart`` have a Jaccard similarity of ``percent``/100."""
    return 100 * (n + m - apart) >= percent * (n + m + apart)


def apart(x: str, y: str) -> Column:
    """Size of the symmetric difference of two sets given by what they add to and lack of one reference."""
    a, b, c, d = F.col(f"{x}adds"), F.col(f"{y}adds"), F.col(f"{x}lacks"), F.col(f"{y}lacks")
    return F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b)) + F.size(c) + F.size(d) - 2 * F.size(F.array_intersect(c, d))


def bit_of(key: str) -> tuple[Column, Column, Column]:
    """The row, the long of it and the bit of that, by which a filter knows a key."""
    h = F.xxhash64(key)
    return h.bitwiseAND(F.lit(GROUPS - 1)).cast("int"), F.shiftright(h, 16).bitwiseAND(F.lit(WORDS - 1)).cast("int"), F.shiftright(h, 32).bitwiseAND(F.lit(63)).cast("int")


def flagged(rows: DataFrame, keys: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``has``, false where the key isn't among the staged ``keys``, and the staged filter: it is of bounded size and sent to every task, keys that share a bit with one of them are true, and an exact join must follow."""
    row, long, bit = bit_of("key")
    bits = keys.select(row.alias("row"), long.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    bits = bits.groupBy("row").agg(F.array(*[F.bit_or(F.when(F.col("w") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))) for i in range(WORDS)]).alias("bits"))
    bits = staged(bits, f"{label}-bits")
    has = F.call_function("shiftright", F.get("bits", long), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return rows.withColumn("row", row).join(F.broadcast(bits), "row", "left").withColumn("has", F.coalesce(has, F.lit(False))).drop("row", "bits"), bits


def sifted(rows: DataFrame, keys: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` without most of those whose key isn't among the staged ``keys``, see ``flagged``."""
    rows, bits = flagged(rows, keys, label)
    return rows.where("has").drop("has"), bits


def shrunk(state: DataFrame, label: str, sift: bool = False) -> DataFrame:
    """``state(id, need, keys)`` without keys that one id alone has; ids with ``need`` such keys are closed and go, ``need`` falls for the rest. ``sift``: a filter goes before the shuffle of many keys, for 17 MB in the driver."""
    rows = state.select("id", "need", F.size("keys").alias("had"), F.explode("keys").alias("key"))
    busy = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), f"{label}-busy")
    bits = None
    if sift and not small(busy, NARROW):  # few rows have a shared key, and only these need the shuffle; a semi join would be put before the filter
        rows, bits = sifted(rows, busy, label)
    left = beside(rows, busy, "key", "inner", NARROW).groupBy("id", "need", "had").agg(F.collect_list("key").alias("keys"))
    out = staged(left.select("id", (F.col("need") - F.col("had") + F.size("keys")).alias("need"), "keys").where("need > 0"), f"{label}-open")
    done(busy, bits)
    return out


def links(nodes: DataFrame, keys: list[Column], need: Column, values_of: Callable[[DataFrame], DataFrame], percent: int, k: int, label: str, room: int = ROOM, core: int = CORE, rounds: int = ROUNDS, unpack: Callable[[Column], Column] = lambda values: values, sift: bool = False, spent: DataFrame | None = None) -> list[DataFrame]:
    """Links (a, b) between nodes whose sets have a Jaccard similarity of ``percent``/100, as staged tables, enough for all components.

    nodes      (id long, sketch array<long>): sketch the smallest values of the set, at most ``k``; staged.
    keys       array<long> columns of nodes, one after the other in use: the lists that a node stands in. Each narrows what the one before left.
    need       of a node, a count of its keys such that no link can miss all of as many of them (or only with a chance that the caller states).
    values_of  takes staged ids (id) and returns (id, values): the whole sets, distinct long values; a set may come more than once.
    unpack     makes these of ``values`` where values_of has them in a shorter form, as a text; only that form is staged and shuffled.
    sift       see ``shrunk``; for nodes whose keys are many and mostly their own.
    spent      a staged table that nobody reads once the open nodes are staged.

    1. A node with ``need`` keys of its own alone is closed: its links would show in one of those. The rest is open.
    2. Each list proposes as hub its member with most shared keys. Members whose sketch is not far from the
       hub's (at most ``room`` percent below the threshold) are its family. In a family of up to FEW members sets
       meet directly. A larger family's sets are written as differences to one reference, the majority of at
       most SAMPLE members. Differences of near copies are small, and give similarities exactly.
    3. All members are compared with the family's middle. For those not linked with it, a partner must have
       an element beyond the reference in common with them, or so few of these that counts decide: the first are
       found by lists of such elements, the second by counts. Only members that aren't known to be connected meet.
    4. A key is settled for a member within ``core`` percent of its hub, as by the triangle inequality its partners
       are family members too. Members with ``need`` settled keys are closed; what is open goes to the next round.
    5. What is open after ``rounds`` rounds is compared block by block in its lists.
    """
    out: list[DataFrame] = []
    families: list[DataFrame] = []
    state = None
    for i, key in enumerate(keys):
        before, state = state, shrunk(nodes.select("id", need.alias("need"), key.alias("keys")), f"{label}-k{i}", sift)
        done(before)
        if i == 0:  # few nodes are open from here on
            nodes = staged(beside(nodes, state.select("id"), "id", "left_semi"), f"{label}-nodes")
            done(spent)
    for r in range(rounds):
        if state.isEmpty():
            break
        found, state, near = hub_round(nodes, state, values_of, percent, k, f"{label}-r{r}", room, core, unpack, sift)
        out += found
        families.append(near)
    if not state.isEmpty():
        out.append(by_blocks(nodes, state, families, values_of, percent, k, label, unpack))
    done(state, nodes, *families)
    return out


def hub_round(nodes: DataFrame, state: DataFrame, values_of: Callable[[DataFrame], DataFrame], percent: int, k: int, label: str, room: int, core: int, unpack: Callable[[Column], Column], sift: bool) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """One round of ``links``: (tables of links, the open nodes left, (hub, id) of the families)."""
    place = F.shiftleft(F.size("keys").cast("long"), 32) + F.xxhash64("id").bitwiseAND(F.lit(0xFFFFFFFF))
    rows = state.select("id", "need", F.size("keys").alias("had"), place.alias("place"), F.explode("keys").alias("key"))
    hubs = rows.groupBy("key").agg(F.max_by("id", "place").alias("hub"))
    at = staged(rows.drop("place").join(hubs, "key").where("id <> hub").groupBy("hub", "id", "need", "had").agg(F.collect_list("key").alias("keys")), f"{label}-at")
    pairs = at.select("hub", "id").join(nodes.select("id", F.col("sketch").alias("x")), "id").join(nodes.select(F.col("id").alias("hub"), F.col("sketch").alias("y")), "hub")
    near = staged(pairs.where(close("x", "y", k, percent - room)).select("hub", "id"), f"{label}-near")
    sizes = near.groupBy("hub").agg((F.count(F.lit(1)) + 1).alias("family"))
    ids = staged(near.select("id").union(near.select("hub")).distinct(), f"{label}-ids")
    values = one_each(values_of(ids), ids, f"{label}-values")
    done(ids)
    found: list[DataFrame] = []
    # small families: each member meets the hub, and the rest where one isn't linked with it
    few = near.join(sizes.where(F.col("family") <= FEW), "hub")
    few = staged(compared(few.select("hub", "family", F.col("hub").alias("a"), F.col("id").alias("b")), values, unpack).select("hub", "family", "b", like(percent).alias("linked"), like(percent - core).alias("core")), f"{label}-few")
    found.append(staged(few.where("linked").select(F.col("hub").alias("a"), "b"), f"{label}-few-links"))
    open_ = few.groupBy("hub").agg(F.count_if(~F.col("linked")).alias("loose")).where("loose > 0").select("hub")
    some = staged(few.where("family > 2").join(open_, "hub", "left_semi").select("hub", "b", "linked"), f"{label}-few-some")
    if not some.isEmpty():
        loose = some.where("not linked").select("hub", F.col("b").alias("a")).join(some, "hub").where("a <> b and (linked or a < b)").select("a", "b").distinct()
        loose = staged(loose, f"{label}-few-loose")
        them = staged(loose.select(F.col("a").alias("id")).union(loose.select("b")).distinct(), f"{label}-few-ids")
        found.append(alike(loose, beside(values, them, "id", "left_semi"), percent, f"{label}-few-more", unpack))
        done(loose, them)
    settled = few.where("core").select("hub", F.col("b").alias("id"))
    # large families: differences to one reference
    many = staged(near.join(sizes.where(F.col("family") > FEW), "hub").select("hub", "id"), f"{label}-many")
    seen = split = None
    if not many.isEmpty():
        members = staged(many.union(many.select("hub").distinct().select("hub", F.col("hub").alias("id"))), f"{label}-members")
        them = staged(members.select("id").distinct(), f"{label}-many-ids")
        theirs = staged(beside(values, them, "id", "left_semi"), f"{label}-many-values")
        seen = family_members(members, theirs, percent, core, label, unpack)
        done(members, them, theirs)
        found.append(staged(seen.where("linked and id <> c").select(F.col("c").alias("a"), F.col("id").alias("b")), f"{label}-links"))
        settled = settled.union(seen.where("core").select("hub", "id"))
        split = staged(seen.groupBy("hub").agg(F.count_if(~F.col("linked")).alias("loose")).where("loose > 0").select("hub"), f"{label}-split")
        if not split.isEmpty():
            found += loose_links(seen, split, percent, label)
    left = at.join(settled, ["hub", "id"], "left_anti").groupBy("id", "need", "had").agg(F.flatten(F.collect_list("keys")).alias("keys"))
    left = staged(left.select("id", (F.col("need") - F.col("had") + F.size("keys")).alias("need"), "keys").where("need > 0"), f"{label}-left")
    done(values, few, some, many, seen, split, at, state)
    state = shrunk(left, f"{label}-s", sift)
    done(left)
    return found, state, near


def compared(pairs: DataFrame, values: DataFrame, unpack: Callable[[Column], Column]) -> DataFrame:
    """``pairs(a, b, ...)`` with the sets x of a and y of b."""
    both = pairs.join(values.select(F.col("id").alias("b"), F.col("values").alias("y")), "b").join(values.select(F.col("id").alias("a"), F.col("values").alias("x")), "a")
    return both.withColumns({"x": unpack(F.col("x")), "y": unpack(F.col("y"))})


def like(percent: int) -> Column:
    """Whether the sets x and y have a Jaccard similarity of ``percent``/100."""
    n, m = F.size("x"), F.size("y")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & fits(n, m, n + m - 2 * F.size(F.array_intersect("x", "y")), percent)


def alike(pairs: DataFrame, values: DataFrame, percent: int, label: str, unpack: Callable[[Column], Column]) -> DataFrame:
    """Those of ``pairs(a, b)`` that are ``like``, staged. They are staged with the answer, as a condition on it would unpack the sets again wherever it names them."""
    seen = staged(compared(pairs, values, unpack).select("a", "b", like(percent).alias("linked")), label)
    out = seen.where("linked").select("a", "b")
    out._loomrank_path = seen._loomrank_path
    return out


def family_members(members: DataFrame, values: DataFrame, percent: int, core: int, label: str, unpack: Callable[[Column], Column]) -> DataFrame:
    """members(hub, id) with what their sets add to and lack of the family's reference, the member c nearest to that, and whether they are linked with c, and near the hub."""
    some = members.withColumn("turn", F.row_number().over(W.partitionBy("hub").orderBy(F.xxhash64("id"), "id"))).where(F.col("turn") <= SAMPLE)
    votes = some.join(values, "id").groupBy("hub").agg(F.count(F.lit(1)).alias("voters"), F.flatten(F.transform(F.collect_list("values"), unpack)).alias("all"))  # at most SAMPLE sets
    votes = votes.select("hub", "voters", F.explode("all").alias("v")).groupBy("hub", "v").agg(F.count(F.lit(1)).alias("n"), F.max("voters").alias("voters"))
    refs = votes.where("2 * n > voters").groupBy("hub").agg(F.collect_list("v").alias("ref"))
    refs = staged(members.select("hub").distinct().join(refs, "hub", "left").select("hub", F.coalesce("ref", F.array().cast("array<long>")).alias("ref")), f"{label}-refs")
    away = members.join(values, "id").join(refs, "hub").withColumn("values", unpack(F.col("values"))).select("hub", "id", F.size("values").alias("n"), F.array_except("values", "ref").alias("adds"), F.array_except("ref", "values").alias("lacks"))
    away = staged(away, f"{label}-away")
    size = (F.size("adds") + F.size("lacks")).cast("long")
    middle = away.groupBy("hub").agg(F.min_by("id", F.shiftleft(size, 32) + F.xxhash64("id").bitwiseAND(F.lit(0xFFFFFFFF))).alias("id"))
    middle = middle.join(away, ["hub", "id"]).select("hub", F.col("id").alias("c"), F.col("n").alias("c_n"), F.col("adds").alias("c_adds"), F.col("lacks").alias("c_lacks"))
    own = away.where("id = hub").select("hub", F.col("n").alias("h_n"), F.col("adds").alias("h_adds"), F.col("lacks").alias("h_lacks"))
    seen = away.join(middle.join(own, "hub"), "hub").select(
        "hub", "id", "c", "n", "adds", "lacks", fits(F.col("n"), F.col("c_n"), apart("", "c_"), percent).alias("linked"), fits(F.col("n"), F.col("h_n"), apart("", "h_"), percent - core).alias("core")
    )
    seen = staged(seen, f"{label}-seen")
    done(refs, away)
    return seen


def loose_links(seen: DataFrame, split: DataFrame, percent: int, label: str) -> list[DataFrame]:
    """Links of members that aren't linked with their family's middle, see ``links``, step 3, as staged tables.

    ``g`` names what a member is known to be connected with: the middle, or itself at first. Pairs of one g need no
    link. So members that are all alike become one g in a few turns (STARS at most, while a turn links many), each
    member meeting the centre of its lists only, and just what is left between different g is compared pair by pair.
    """
    some = beside(seen, split, "hub", "left_semi").select("hub", "id", "n", "adds", "lacks", F.size("adds").alias("p"), F.size("lacks").alias("q"), "linked", F.when(F.col("linked"), F.col("c")).otherwise(F.col("id")).alias("g"))
    some = staged(some, f"{label}-some")
    out: list[DataFrame] = []

    def mixed(rows: DataFrame, turn: int) -> DataFrame:
        lists = rows.groupBy("hub", "v").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("hub", "v")
        return staged(rows.join(lists, ["hub", "v"], "left_semi"), f"{label}-rows{turn}")

    def side(rows: DataFrame, x: str) -> list[Column]:
        return [F.col("id").alias(x), *[F.col(c).alias(f"{x}{c}") for c in ("hub", "v", "i", "n", "p", "q", "g", *words)]]

    def exact(pairs: DataFrame) -> DataFrame:
        x = some.select("hub", F.col("id").alias("a"), F.col("n").alias("an"), F.col("adds").alias("a_adds"), F.col("lacks").alias("a_lacks"))
        y = some.select("hub", F.col("id").alias("b"), F.col("n").alias("bn"), F.col("adds").alias("b_adds"), F.col("lacks").alias("b_lacks"))
        return pairs.join(x, ["hub", "a"]).join(y, ["hub", "b"]).where(fits(F.col("an"), F.col("bn"), apart("a_", "b_"), percent))

    # whether an odd number of a difference's elements falls to each of PARITY bits: two sets differ in as many elements at least as bits
    words = [f"w{i}" for i in range(PARITY // 64)]
    bits = some.select("hub", "id", F.explode(F.concat("adds", "lacks")).alias("x")).select("hub", "id", F.pmod("x", F.lit(len(words))).alias("w"), F.expr("shiftleft(1L, cast(shiftright(x, 20) & 63 as int))").alias("bit"))
    bits = bits.groupBy("hub", "id").agg(*[F.bit_xor(F.when(F.col("w") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(c) for i, c in enumerate(words)])
    odd = reduce(Column.__add__, [F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in words])
    # an element beyond the reference in common: a partner lacks at most a part of a set, so the first common one is among the first of both; what stands before it is not common
    first = F.slice(F.sort_array("adds"), F.lit(1), F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1)
    rows = mixed(some.select("hub", "id", "n", "p", "q", "g", F.posexplode(first).alias("i", "v")), 0)
    with_bits = staged(rows.join(bits, ["hub", "id"]), f"{label}-bits")
    done(rows)
    rows = with_bits
    least = F.col("ap") + F.col("bp") - 2 * F.least(F.col("ap") - F.col("ai"), F.col("bp") - F.col("bi")) + F.abs(F.col("aq") - F.col("bq"))
    alike = fits(F.col("an"), F.col("bn"), least, percent) & fits(F.col("an"), F.col("bn"), odd, percent)
    same = (F.col("ahub") == F.col("bhub")) & (F.col("av") == F.col("bv"))
    names = some.select("hub", "id", "g")
    for turn in range(STARS):
        if rows.isEmpty():
            break
        place = F.shiftleft(F.hash(F.lit(turn), "g").cast("long"), 32) + F.xxhash64("id").bitwiseAND(F.lit(0xFFFFFFFF))  # each g has the same chance, in all lists alike
        centres = rows.join(rows.groupBy("hub", "v").agg(F.max_by("id", place).alias("id")), ["hub", "v", "id"], "left_semi")
        pairs = staged(rows.select(*side(rows, "a")).join(centres.select(*side(centres, "b")), same & (F.col("ag") != F.col("bg")) & alike).select(F.col("ahub").alias("hub"), "a", "b", "ag", "bg").distinct(), f"{label}-stars{turn}")
        found = staged(exact(pairs).select("a", "b", "ag", "bg"), f"{label}-met{turn}")
        done(pairs)
        out.append(found.select("a", "b"))
        out[-1]._loomrank_path = found._loomrank_path
        many = found.count() * 64 > rows.count()
        if found.isEmpty():
            break
        comp = components(found.select(F.col("ag").alias("a"), F.col("bg").alias("b")), f"{label}-g{turn}").withColumnsRenamed({"id": "g"})
        comp = comp.select("g", "comp")
        renamed = [staged(t.join(comp, "g", "left").withColumn("g", F.coalesce("comp", "g")).select(*t.columns), f"{label}-named{turn}") for t in (names, rows)]
        done(rows, names)
        names, rows = renamed[0], mixed(renamed[1], turn + 1)
        done(renamed[1])
        if not many:
            break
    # members of the g that most of a list have meet only the others
    counts = rows.groupBy("hub", "v", "g").agg(F.count(F.lit(1)).alias("size"))
    lists = counts.groupBy("hub", "v").agg(F.max_by("g", "size").alias("main"), F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    listed = staged(rows.join(lists, ["hub", "v"]), f"{label}-lists")
    x = listed.where("g <> main").select(*side(listed, "a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("ablock"))
    y = listed.select(*side(listed, "b"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("bblock"), "main")
    shared = x.join(y, same & (F.col("ablock") == F.col("bblock")) & (F.col("ag") != F.col("bg")) & ((F.col("bg") == F.col("main")) | (F.col("a") < F.col("b"))) & alike).select(F.col("ahub").alias("hub"), "a", "b")
    # no such element in common: counts must allow it
    able = some.drop("g").join(names, ["hub", "id"]).where(F.col("p") * percent <= (100 - percent) * F.col("n"))
    cells = able.groupBy("hub", "n", "p", "q").agg(F.count_if(~F.col("linked")).alias("loose"))
    s, t = cells.where("loose > 0").select(F.col("hub").alias("sh"), F.col("n").alias("sn"), F.col("p").alias("sp"), F.col("q").alias("sq")), cells.select(F.col("hub").alias("th"), F.col("n").alias("tn"), F.col("p").alias("tp"), F.col("q").alias("tq"))
    met = s.join(t, (F.col("sh") == F.col("th")) & fits(F.col("sn"), F.col("tn"), F.col("sp") + F.col("tp") + F.abs(F.col("sq") - F.col("tq")), percent)).select(F.col("sh").alias("hub"), "sn", "sp", "sq", "tn", "tp", "tq")
    loose = able.where("not linked").select("hub", F.col("n").alias("sn"), F.col("p").alias("sp"), F.col("q").alias("sq"), F.col("id").alias("a"), F.col("g").alias("ag"))
    all_ = able.select("hub", F.col("n").alias("tn"), F.col("p").alias("tp"), F.col("q").alias("tq"), F.col("id").alias("b"), "linked", F.col("g").alias("bg"))
    counted = met.join(loose, ["hub", "sn", "sp", "sq"]).join(all_, ["hub", "tn", "tp", "tq"]).where("ag <> bg and (linked or a < b)").select("hub", "a", "b")
    pairs = staged(shared.union(counted).distinct(), f"{label}-loose")
    done(rows, listed, names)
    out.append(staged(exact(pairs).select("a", "b"), f"{label}-more"))
    done(pairs, some)
    return out


def by_blocks(nodes: DataFrame, state: DataFrame, families: list[DataFrame], values_of: Callable[[DataFrame], DataFrame], percent: int, k: int, label: str, unpack: Callable[[Column], Column]) -> DataFrame:
    """Links within what is left of the lists: each block of BLOCK members meets each other, the estimate stands in the join, and exact sets decide.

    Pairs within a family of an earlier round have been compared there, and are left out.
    """
    of = [f.select("id", F.struct(F.lit(r).alias("r"), "hub").alias("f")).union(f.select("hub", F.struct(F.lit(r).alias("r"), "hub")).distinct()) for r, f in enumerate(families)]
    of = reduce(DataFrame.union, of).join(state.select("id"), "id", "left_semi").groupBy("id").agg(F.collect_set("f").alias("fs"))
    rows = state.join(of, "id", "left").select("id", "keys", F.coalesce("fs", F.array().cast("array<struct<r:int,hub:bigint>>")).alias("fs"), F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = staged(rows.join(sizes, "key").join(nodes.select("id", "sketch"), "id"), f"{label}-rest")
    x = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("a"), F.col("keys").alias("ka"), F.col("fs").alias("fa"), F.col("sketch").alias("x"))
    y = rows.select("key", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.col("id").alias("b"), F.col("keys").alias("kb"), F.col("fs").alias("fb"), F.col("sketch").alias("y"))
    once = F.array_min(F.array_intersect("ka", "kb")) == x["key"]  # a pair counts in one of its lists
    pairs = x.join(y, (x["key"] == y["key"]) & (x["block"] == y["block"]) & (F.col("a") < F.col("b")) & close("x", "y", k, percent - ROOM // 2) & once & ~F.arrays_overlap("fa", "fb")).select("a", "b")
    pairs = staged(pairs, f"{label}-rest-pairs")
    ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), f"{label}-rest-ids")
    values = one_each(values_of(ids), ids, f"{label}-rest-values")
    out = alike(pairs, values, percent, f"{label}-rest-links", unpack)
    done(rows, pairs, ids, values)
    return out


def joined(tables: list[DataFrame], empty: DataFrame) -> DataFrame:
    """All links of ``tables`` as one; ``empty`` has the columns a and b."""
    return reduce(DataFrame.union, tables, empty)
