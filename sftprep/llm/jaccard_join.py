"""Jaccard self-join of shingle sets with a token-group matrix.

Documents with equal sets form a class, and only one of a class goes on. Similar classes are
partitioned into groups, bounded in members and in tokens. Of each group its row of the
token-group matrix is stored: the union of its members' tokens, and a bit for each member and
token. Two groups meet only when they share a signature (below). The overlap of a document with
the other group's union bounds its overlap with every member; only if this bound lets a
document reach the threshold is the group opened, where bits give all exact overlaps at once.

The smaller group of a pair always goes to the larger one. First only a sketch of its union
goes, a bitmap of the tokens' hashes, which never makes an overlap look smaller; the whole row
follows for the pairs that this leaves. The larger group is read once for a block of partners.

Signatures lose no pair. A set differs from any it links with in at most ``D`` tokens, where
``D`` follows from its own size. Tokens are hashed into more than ``D`` parts, and the contents
of a set's first ``D + 1`` parts with tokens are its signatures: the first part that is equal in
both sets comes after parts that differ only, so it is among the signatures of either. This is
done with the rare tokens alone, so that passages and phrases of many documents bring nobody
together. A set with too few parts of rare tokens signs all it has, and signs all its tokens as
well: its first ``D + 1`` parts, or all of them, those without tokens included. Two sets of that
sort have an equal part in any case. Sizes fall into levels so that both documents use the same
number of parts; a document near the lower end of a level also signs as the level below. As
``D`` is the set's own, few sets lack parts, and hardly any has to sign those without tokens,
which all of a level share.

Which tokens are rare is taken from a sample, a fixed share of a large table: so a rare token is
in about the same number of documents at every size, and the groups that it brings together
stay in proportion. It is only a matter of speed, as signatures lose no pair whatever tokens are
called rare.

Groups that share a signature first meet the signature's hub, the smallest of them, which is
linear in the size of even the largest family of copies. After that, groups meet pairwise
unless all of both is already one component; such groups stand together as one when pairs are
made, so a family that is connected costs one row. So every pair is either verified or already
connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sftprep.llm.common import worker_memory
from sftprep.storage import stored

#: Documents of the sample that tells frequent tokens, or one of so many if that is more; in how
#: many of them those tokens are; and how many tokens are called frequent at most.
SAMPLE, ONE_OF, OFTEN, FREQUENT = 5000, 8, 4, 1 << 21
#: Members of a group and tokens of all of them, about; partners of a group in one block; bits
#: of a sketch for each token; words a worker remembers the hashes of.
GROUP, GROUP_TOKENS, PARTNERS, SKETCH = 128, 1 << 16, 64, 4
#: Rows of a group id and a number that may be sent to all tasks, of 16 bytes each.
SENT = 1 << 20
REMEMBERED = 400_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class Shingler:
    """Texts to sorted arrays of 64-bit shingle hashes; remembers hashes of words."""

    def __init__(self, width: int):
        import xxhash

        self.width, self.hash = width, xxhash.xxh3_64_intdigest
        self.memory = worker_memory(("shingles",), REMEMBERED)

    def _work_out(self, words: list[bytes]) -> dict[bytes, int]:
        return dict(zip(words, map(self.hash, words)))

    def tokens(self, text: str) -> np.ndarray:
        """Hashes of the distinct shingles; a shorter sequence of words is one by itself."""
        words = text.encode("utf-8").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(words) < self.width:
            return np.array([self.hash(b" ".join(words), seed=1)], dtype=np.uint64)
        h = np.array(self.memory.look_up([words], self._work_out)[0], dtype=np.uint64)
        n = len(h) - self.width + 1
        s = np.zeros(n, dtype=np.uint64)
        for k in range(self.width):
            s = (s ^ (s >> np.uint64(29))) * _MIX[0] + h[k : k + n] * _MIX[1]
        s = (s ^ (s >> np.uint64(32))) * _MIX[2]
        return np.unique(s ^ (s >> np.uint64(29)))


class Levels:
    """Levels of set sizes for a threshold of ``percent``."""

    def __init__(self, percent: int):
        self.percent = percent
        self.least = -(-percent // (100 - percent))  # smaller sets only link with equal ones
        self.starts = [self.least]

    def reach(self, size: int) -> int:
        """The largest set that a set of this size can link with."""
        return 100 * size // self.percent

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            nxt = self.starts[-1]
            for _ in range(3):
                nxt = self.reach(nxt) + 1
            self.starts.append(nxt)
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def _differ(self, both: int) -> int:
        """The most tokens by which sets of ``both`` tokens in all differ if they link."""
        return both * (100 - self.percent) // (100 + self.percent)

    def parts(self, level: int) -> int:
        """The number of parts: more than any ``D`` of sets that sign as the level."""
        largest = self.starts[level + 1] - 1
        differ = self._differ(largest + self.reach(largest))
        return differ + 3 + differ // 6

    def differ(self, size: int, level: int) -> int:
        """``D`` of a set that signs as a level: its own, or the one below to meet that one's sets."""
        own = level == self.of(size)
        return self._differ(size + (self.reach(size) if own else self.starts[level + 1] - 1))

    def signing(self, size: int) -> list[int]:
        if size < self.least:
            return []
        level = self.of(size)
        below = level > 0 and size <= self.reach(self.starts[level] - 1)
        return [level, level - 1] if below else [level]


def _parts(tokens: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that hold tokens, and a hash of each one's content."""
    if not len(tokens):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    part = ((tokens >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    own, first = np.unique(part[order], return_index=True)
    mixed = (tokens ^ (tokens << np.uint64(13))) * _MIX[1]
    return own, np.add.reduceat(mixed[order], first)


def signatures(tokens: np.ndarray, levels: Levels, frequent: np.ndarray) -> np.ndarray:
    """The signatures of a set, given the sorted tokens that are not rare."""
    out = []
    rare = tokens
    if len(frequent) and len(tokens):
        place = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        rare = tokens[frequent[place] != tokens]
    for level in levels.signing(len(tokens)):
        differ, m = levels.differ(len(tokens), level), levels.parts(level)
        own, content = _parts(rare, m)
        found = [(0, own[: differ + 1], content[: differ + 1])]
        if len(own) <= differ:
            own, content = _parts(tokens, m)
            if len(own) > differ:
                own, content = own[: differ + 1], content[: differ + 1]
            else:
                empty = np.setdiff1d(np.arange(m), own)
                own = np.concatenate([own, empty])
                content = np.concatenate([content, np.zeros(len(empty), dtype=np.uint64)])
            found.append((1, own, content))
        for kind, own, content in found:
            place = own.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(2 * level + 2 + kind)
            s = (content ^ (content >> np.uint64(31))) * _MIX[0] + place * _MIX[2]
            out.append((s ^ (s >> np.uint64(30))) * _MIX[1])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def frequent_tokens(given: DataFrame, width: int) -> np.ndarray:
    """Tokens in at least ``OFTEN`` documents of a sample, those of the smallest hash.

    The sample is ``SAMPLE`` documents, or a fixed share of a larger table. At most
    ``FREQUENT`` tokens, those in the most documents, whatever the size of the table.
    """
    share = min(1.0, max(SAMPLE / max(given.count(), 1), 1 / ONE_OF))
    sample = given.filter(
        F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    ).select("text")

    def tokens_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for batch in batches:
            found, held = [], 0
            for t in batch["text"]:
                found.append(shingler.tokens(t).view(np.int64))
                held += len(found[-1])
                if held > 1 << 19:
                    yield pd.DataFrame({"token": np.concatenate(found)})
                    found, held = [], 0
            if held:
                yield pd.DataFrame({"token": np.concatenate(found)})

    counts = sample.mapInPandas(tokens_of, "token long").groupBy("token").count()
    often = stored(counts.filter(F.col("count") >= OFTEN), "frequent")
    least, held = OFTEN, 0
    for count, n in sorted(often.groupBy("count").agg(F.count(F.lit(1))).collect(), reverse=True):
        held += n
        if held > FREQUENT:
            least = count + 1
            break
    rows = often.filter(F.col("count") >= least).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(dtype=np.int64).view(np.uint64))


def linked(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether ``100 * intersection >= percent * union``."""
    return 100 * overlap >= percent * (a + b - overlap)


def spanning(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest node linked with it, over pairs (rows, cols)."""
    label = np.arange(n)
    while len(rows):
        low = np.minimum(label[rows], label[cols])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, cols, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


class Group:
    """A row of the token-group matrix: token union, and a packed bit for each member and token."""

    def __init__(self, members: np.ndarray, union: np.ndarray, bits: np.ndarray):
        self.members, self.union, self.bits = members, union, bits
        self.sizes = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)

    @classmethod
    def of(cls, members: list[int], sets: list[np.ndarray]) -> Group:
        union = np.unique(np.concatenate(sets))
        bits = np.zeros((len(sets), -(-len(union) // 8)), dtype=np.uint8)
        for packed, own in zip(bits, sets):
            row = np.zeros(len(union), dtype=bool)
            row[np.searchsorted(union, own)] = True
            packed[:] = np.packbits(row)
        return cls(np.array(members, dtype=np.int64), union, bits)

    @classmethod
    def read(cls, members, tokens, bits: bytes) -> Group:
        union = np.asarray(tokens).view(np.uint64)
        packed = np.frombuffer(bits, dtype=np.uint8).reshape(len(members), -1)
        return cls(np.asarray(members), union, packed)

    def overlaps(self, held: np.ndarray) -> np.ndarray:
        """How many of each member's tokens are among those of the union that ``held`` marks."""
        return np.bitwise_count(self.bits & np.packbits(held)).sum(axis=1, dtype=np.int64)

    def columns(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Bits of some members and tokens, as numbers to multiply."""
        return np.unpackbits(self.bits[rows], axis=1)[:, places].astype(np.float32)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of hashes of the tokens, of ``SKETCH`` bits each or a little more."""
    size = 1 << max(6, int(SKETCH * len(tokens) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[_sketched(tokens, size)] = True
    return np.packbits(bits)


def _sketched(tokens: np.ndarray, size: int) -> np.ndarray:
    return ((tokens * _MIX[2]) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def may_link(a: Group, sketched: bytes, percent: int) -> bool:
    """Whether a member of ``a`` may link with one of a group, given the sketch of its union."""
    bits = np.unpackbits(np.frombuffer(sketched, dtype=np.uint8)).astype(bool)
    bound = a.overlaps(bits[_sketched(a.union, len(bits))])
    return bool(linked(bound, a.sizes, bound, percent).any())


def open_groups(a: Group, b: Group, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the members that link."""
    in_a, in_b = np.isin(a.union, b.union), np.isin(b.union, a.union)
    # no member of b overlaps more than the bound; its size is at least that
    bound, back = a.overlaps(in_a), b.overlaps(in_b)
    may = np.flatnonzero(linked(bound, a.sizes, bound, percent))
    other = np.flatnonzero(linked(back, b.sizes, back, percent))
    if not len(may) or not len(other):
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    places, same = np.flatnonzero(in_a), np.flatnonzero(in_b)  # both in rising order of tokens
    overlap = np.zeros((len(may), len(other)), dtype=np.int64)
    for lo in range(0, len(places), 1 << 14):
        x = a.columns(may, places[lo : lo + (1 << 14)])
        overlap += (x @ b.columns(other, same[lo : lo + (1 << 14)]).T).astype(np.int64)
    x, y = np.nonzero(linked(overlap, a.sizes[may][:, None], b.sizes[other][None, :], percent))
    return may[x], other[y]


def components(links: DataFrame, label: str) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``links (a, b)``; the smallest node names it.

    Labels spread along links and jump to the label's own label, so rounds grow with the
    logarithm of a component's diameter. Each round is a written table.
    """
    both = stored(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), label
    )
    nodes = stored(
        both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.col("node")).alias("component")
        ),
        label,
    )
    while True:
        near = both.join(nodes, both["b"] == nodes["node"]).groupBy("a").agg(
            F.min("component").alias("near")
        )
        low = nodes.join(near, nodes["node"] == near["a"]).select(
            "node", F.least("component", "near").alias("low"), "component"
        )
        jump = nodes.select(F.col("node").alias("at"), F.col("component").alias("next"))
        new = stored(
            low.join(jump, F.col("low") == F.col("at")).select(
                "node",
                F.least("low", "next").alias("component"),
                (F.least("low", "next") != F.col("component")).alias("moved"),
            ),
            label,
        )
        moved = new.filter("moved").limit(1).count()
        nodes = new.select("node", "component")
        if not moved:
            return nodes


def jaccard_join(
    docs: DataFrame, doc_id: str, text: Column, percent: int = 90, width: int = 3
) -> DataFrame:
    """Rows ``(doc_id, n_shingles, component_id)``, one for each row of ``docs``.

    Words are runs of anything but white space, A-Z in lower case; a set holds the distinct
    shingles of ``width`` words, or all words as one if there are fewer. Sets link when
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest id reachable.
    Null and blank texts have an empty set and link with nothing. Rows with a null id keep
    their count and get a null component. Rows that repeat an id count as one document.
    Shingles are compared by 64-bit hashes, sets for equality by 128 bits.
    """
    levels = Levels(percent)
    given = docs.select(
        F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")
    )

    frequent = frequent_tokens(given, width)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingler = Shingler(width)
        for batch in batches:
            rows = []
            for t in batch["text"]:
                tokens = shingler.tokens(t)
                digest = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), dtype=np.int64)
                rows.append((len(tokens), digest[0], digest[1], signatures(tokens, levels, frequent)))
            yield pd.DataFrame(rows, columns=["n", "h1", "h2", "sigs"]).assign(id=batch["id"].values)

    signed = stored(
        given.mapInPandas(sign, "n long, h1 long, h2 long, sigs array<long>, id long"), "signed"
    )
    classes = stored(
        signed.filter("n > 0 and id is not null")
        .groupBy("h1", "h2")
        .agg(F.min("id").alias("rep")),
        "classes",
    )
    pairs = _links(given, signed, classes, percent, width)
    component = components(pairs, "components")
    named = classes.join(component, F.col("rep") == F.col("node"), "left").select(
        "h1", "h2", F.coalesce("component", "rep").alias("found")
    )
    own = F.when(F.col("id").isNotNull(), F.coalesce("found", "id"))
    return signed.drop("sigs").join(named, ["h1", "h2"], "left").select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), own.alias("component_id")
    )


def _links(
    given: DataFrame, signed: DataFrame, classes: DataFrame, percent: int, width: int
) -> DataFrame:
    """Links ``(a, b)`` between classes, enough of them to connect what is connected."""
    reps = signed.filter("size(sigs) > 0").join(
        classes, ["h1", "h2"]
    ).filter("id = rep").select("id", "sigs")
    by_id = Window.partitionBy("sig").orderBy("id")
    postings = reps.select("id", F.explode("sigs").alias("sig")).select(
        "id", "sig", F.lag("id").over(by_id).alias("before"), F.lead("id").over(by_id).alias("after")
    )
    shared = F.col("before").isNotNull() | F.col("after").isNotNull()
    postings = stored(postings.filter(shared).select("sig", "id"), "postings")
    family = postings.groupBy("id").agg(F.min("sig").alias("family"))
    # rows that repeat an id count as one
    family = family.join(signed.groupBy("id").agg(F.max("n").alias("n")), "id")
    sizes = family.groupBy("family").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("n") / GROUP_TOKENS)).alias("units")
    )
    unit = F.pmod(F.xxhash64("id"), F.col("units"))
    placed = family.join(sizes, "family").select(
        "id", F.xxhash64("family", unit).alias("grp")
    )
    placed = stored(placed, "placed")

    def tokens_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for batch in batches:
            sets = [shingler.tokens(t).view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({"grp": batch["grp"], "id": batch["id"], "tokens": sets})

    def build(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(t).view(np.uint64) for t in group["tokens"]]
        order = np.argsort(group["id"].to_numpy(), kind="stable")
        g = Group.of(group["id"].to_numpy()[order].tolist(), [sets[k] for k in order])
        x, y = open_groups(g, g, percent)
        return pd.DataFrame(
            {
                "grp": [group["grp"].iloc[0]],
                "members": [g.members],
                "own": [g.members[spanning(x, y, len(g.members))]],
                "tokens": [g.union.view(np.int64)],
                "bits": [g.bits.tobytes()],
                "sketch": [sketch(g.union).tobytes()],
            }
        )

    matrix = stored(
        given.join(placed.hint("merge"), "id")  # the same plan at every size
        .select("id", "grp", "text")
        .mapInPandas(tokens_of, "grp long, id long, tokens array<long>")
        .groupBy("grp")
        .applyInPandas(
            build,
            "grp long, members array<long>, own array<long>, tokens array<long>, bits binary, sketch binary",
        ),
        "matrix",
    )
    inner = matrix.select(F.explode(F.arrays_zip("members", "own")).alias("x")).select(
        F.col("x.members").alias("a"), F.col("x.own").alias("b")
    )
    size = matrix.select("grp", (F.size("tokens") * 8 + F.length("bits")).alias("size"))
    columns = postings.join(placed, "id").select("sig", "grp").distinct()
    columns = stored(columns.join(size, "grp"), "columns")
    smallest = F.min(F.struct("size", "grp"))
    hubs = columns.groupBy("sig").agg(smallest.alias("hub")).select("sig", "hub.grp", "hub.size")
    hubs = hubs.withColumnsRenamed({"grp": "light", "size": "least"})
    first = stored(
        columns.join(hubs, "sig")
        .filter("grp != light")
        .select(F.col("grp").alias("heavy"), "light")
        .distinct(),
        "hubs",
    )
    found = inner.union(_opened(first, matrix, percent))
    found = stored(found.distinct(), "links")
    component = components(found, "first-components")
    whole = placed.join(component, F.col("id") == F.col("node")).groupBy("grp").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    # a group that is one component stands for all such groups, any other for itself
    one = F.col("lo") == F.col("hi")
    known = columns.join(whole, "grp").select(
        "sig", "grp", "size", F.when(one, F.struct("lo", F.lit(-1).cast("long").alias("of"))).otherwise(
            F.struct(F.lit(0).cast("long").alias("lo"), F.col("grp").alias("of"))
        ).alias("cls"),
    )
    several = known.groupBy("sig").agg(F.min("cls").alias("x"), F.max("cls").alias("y"))
    known = stored(known.join(several.filter("x != y").select("sig"), "sig"), "known")
    kinds = known.select("sig", "cls").distinct()
    meeting = kinds.alias("l").join(
        kinds.alias("r"), (F.col("l.sig") == F.col("r.sig")) & (F.col("l.cls") < F.col("r.cls"))
    ).select("l.sig", F.col("l.cls").alias("c1"), F.col("r.cls").alias("c2"))

    def members(k: int) -> DataFrame:
        names = {"cls": f"c{k}", "grp": f"g{k}", "size": f"s{k}"}
        return known.withColumnsRenamed(names)

    rest = meeting.join(members(1), ["sig", "c1"]).join(members(2), ["sig", "c2"])
    lighter = F.struct("s1", "g1") < F.struct("s2", "g2")
    rest = rest.select(
        F.when(lighter, F.col("g2")).otherwise(F.col("g1")).alias("heavy"),
        F.when(lighter, F.col("g1")).otherwise(F.col("g2")).alias("light"),
    ).distinct()
    rest = stored(rest.join(first, ["heavy", "light"], "left_anti"), "rest")
    return found.union(stored(_opened(rest, matrix, percent), "links"))


def _sent(ids: DataFrame) -> DataFrame:
    """A stored table of group ids, to be sent to the rows it is joined with if it is small."""
    return F.broadcast(ids) if ids.count() <= SENT else ids.hint("merge")


def _opened(pairs: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """Spanning links of the pairs of groups ``(heavy, light)``."""

    def bound(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = [Group.read(x.members, x.tokens, x.bits) for x in left.itertuples(index=False)]
        keep = [bool(own) and may_link(own[0], x, percent) for x in right["its_sketch"]]
        return right.loc[keep, ["heavy", "light"]]

    def opened(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for heavy in left.itertuples(index=False):
            g1 = Group.read(heavy.members, heavy.tokens, heavy.bits)
            for light in right.itertuples(index=False):
                g2 = Group.read(light.its_members, light.its_tokens, light.its_bits)
                x, y = open_groups(g1, g2, percent)
                ids = np.concatenate([g1.members, g2.members])
                label = spanning(x, y + len(g1.members), len(ids))
                moved = np.flatnonzero(label != np.arange(len(ids)))
                a.append(ids[moved])
                b.append(ids[label[moved]])
        return pd.DataFrame(
            {"a": np.concatenate(a or [[]]), "b": np.concatenate(b or [[]])}, dtype="int64"
        )

    def met(pairs: DataFrame, fields: list[str], work, schema: str) -> DataFrame:
        """``work`` on each heavy group with blocks of its light ones, of which ``fields`` go."""
        counted = pairs.groupBy("heavy").agg(
            F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("units")
        )
        counted = stored(counted.select(F.col("heavy").alias("grp"), "units"), "partners")
        light = matrix.select("grp", *(F.col(x).alias(f"its_{x}") for x in fields))
        if "tokens" in fields:  # only some groups are opened
            light = light.join(_sent(stored(pairs.select(F.col("light").alias("grp")).distinct(), "opened")), "grp")
        units = counted.select(F.col("grp").alias("heavy"), "units")
        unit = F.pmod(F.xxhash64("light"), F.col("units")).cast("int")
        right = pairs.join(_sent(units), "heavy").withColumn("unit", unit).drop("units")
        right = right.join(light.withColumnRenamed("grp", "light"), "light")
        left = matrix.join(_sent(counted), "grp").select(
            "grp",
            F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"),
            "members",
            "tokens",
            "bits",
        )
        groups = left.groupBy("grp", "unit"), right.groupBy("heavy", "unit")
        return groups[0].cogroup(groups[1]).applyInPandas(work, schema)

    left = stored(met(pairs, ["sketch"], bound, "heavy long, light long"), "bounded")
    return met(left, ["members", "tokens", "bits"], opened, "a long, b long")
