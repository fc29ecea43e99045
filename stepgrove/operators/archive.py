"""Append-once archive: identity, sequence numbers, behaviour signatures and novelty."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions import sets
from ..session import materialize
from .ordering import SAMPLE_SIZE, ordinal, stride_sample

#: Entries of a block, new entries compared at a time, rules whose bits are held at a time, and the most tasks.
BLOCK_ROWS = 4096
TILE_ROWS = 128
RULE_BITS = 4096
MOST_TASKS = 2000


def signatures(choices, keys, order, action="action", size=SAMPLE_SIZE, **options):
    """One signature per key: the actions at a fixed stride of its rows, at most ``size`` of them.

    ``sample_id`` names the sample (number of rows and stride), so other samples never compare.
    """
    picked = stride_sample(choices, keys, order, size, **options)
    return (
        picked.groupBy(*keys, "group_rows", "stride")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col(action).alias("action")))).alias("_s"))
        .select(
            *keys,
            F.md5(F.concat_ws(":", "group_rows", "stride")).alias("sample_id"),
            F.transform("_s", lambda s: s["action"]).alias("signature"),
        )
    )


def behaviour_distance(a="a", b="b"):
    """Mismatch share of two signature structs (sample_id, signature); null unless comparable."""
    return sets.mismatch_share(
        F.col(f"{a}.sample_id"), F.col(f"{a}.signature"), F.col(f"{b}.sample_id"), F.col(f"{b}.signature")
    )


def append_once(existing, new, order):
    """Rows of ``new`` not archived yet, first by ``order`` per entry_id, numbered after the archive.

    ``existing`` has entry_id and sequence.
    """
    columns = F.struct(*[F.col(f"`{c}`") for c in new.columns])
    once = new.groupBy("entry_id").agg(F.min_by(columns, F.struct(*order)).alias("r")).select("r.*")
    fresh = once.join(existing.select("entry_id"), "entry_id", "left_anti")
    start = existing.agg(F.coalesce(F.max("sequence") + 1, F.lit(0))).scalar()
    numbered = ordinal(fresh, [], order, "sequence")
    return numbered.withColumn("sequence", F.col("sequence") + start)


def index_mismatches(index, entries):
    """Positions where the archive index and the entries disagree; must be empty."""
    a = index.select("sequence", F.col("entry_id").alias("index_id"))
    b = entries.select("sequence", F.col("entry_id").alias("entry_id"))
    return a.join(b, "sequence", "full_outer").filter(~F.col("index_id").eqNullSafe(F.col("entry_id")))


def _packed(table):
    """A table as bytes."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _codes(column):
    """Integers that are equal exactly where the values of a column are; null is a value like any other."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _words(bits):
    """The rows of a matrix of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def _counted(words, shape, most):
    """Sum of the bits set in the words, one (rows x rows) matrix of them at a time; ``most`` bits at the utmost."""
    total = np.zeros(shape, np.uint8 if most < 255 else np.int32)
    for word in words:
        total += np.bitwise_count(word)
    return total


class _Best:
    """Per new entry the least distance met so far and the earliest entry at that distance."""

    def __init__(self, n):
        self.distance, self.at = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max)

    def meet(self, rows, distance, at):
        closer = (distance < self.distance[rows]) | ((distance == self.distance[rows]) & (at < self.at[rows]))
        self.distance[rows[closer]], self.at[rows[closer]] = distance[closer], at[closer]


class _Pair:
    """The new entries of one block beside the entries of an earlier block, or of the same."""

    def __init__(self, new, old):
        both, self.n = pa.concat_tables([new, old]), len(new)
        self.both, self.sequence = both, both["sequence"].to_numpy()
        self.kind = both["kind"].to_pylist()
        self.kinds = _codes(both["kind"])
        length = pc.list_value_length(both["signature"])
        named = pa.table({"sample_id": both["sample_id"], "length": length})
        open_ = pc.and_(pc.is_valid(named["sample_id"]), pc.is_valid(named["length"])).to_numpy()
        codes = pd.DataFrame({"a": _codes(named["sample_id"]), "b": pc.fill_null(length, -1).to_numpy()})
        # Entries of one group are comparable; -1 is comparable with none.
        self.group = np.where(open_, codes.groupby(["a", "b"]).ngroup().to_numpy(), -1)
        self.spec, self.behaviour, self.near = np.full(self.n, np.inf), np.full(self.n, np.inf), _Best(self.n)

    def tiles(self, chosen):
        """(new rows, old rows, mask of the pairs that are not earlier, or None) of some rows, a few new ones at a time."""
        new, old = chosen[chosen < self.n], chosen[chosen >= self.n]
        for start in range(0, len(new) if len(old) else 0, TILE_ROWS):
            part = new[start : start + TILE_ROWS]
            later = None
            if self.sequence[old[-1]] >= self.sequence[part].min():
                later = self.sequence[old][None, :] >= self.sequence[part][:, None]
            yield part, old, later

    def behaviours(self):
        """Share of differing actions, in groups of comparable entries."""
        order = np.argsort(self.group, kind="stable")
        for chosen in np.split(order, np.flatnonzero(np.diff(self.group[order])) + 1):
            if self.group[chosen[0]] < 0 or chosen[0] >= self.n or chosen[-1] < self.n:
                continue
            actions = self.both["signature"].take(pa.array(chosen)).combine_chunks()
            width = len(actions[0])
            codes = _codes(pa.chunked_array([actions.flatten()])).reshape(len(chosen), width)
            planes = [_words(codes >> p & 1) for p in range(max(1, int(codes.max(initial=0)).bit_length()))]
            for new, old, later in self.tiles(chosen):
                i, j = np.searchsorted(chosen, new), np.searchsorted(chosen, old)
                words = (
                    np.bitwise_or.reduce([x[i, w][:, None] ^ x[j, w][None, :] for x in planes]) if len(planes) > 1
                    else planes[0][i, w][:, None] ^ planes[0][j, w][None, :]
                    for w in range(planes[0].shape[1])
                )
                differing = _counted(words, (len(new), len(old)), width)
                if later is not None:
                    differing[later] = width + 1
                nearest = differing.argmin(axis=1)
                least = differing[np.arange(len(new)), nearest].astype(np.int64)
                met = least <= width
                distance = least[met] / max(width, 1)
                self.behaviour[new[met]] = distance
                self.near.meet(new[met], distance, self.sequence[old[nearest[met]]])

    def fixed(self):
        """Entries of other kinds, at distance 1, and of equal kinds that have no parameters, at 0: the earliest of each."""
        old, kinds, groups = self.sequence[self.n :], self.kinds[self.n :], self.group[self.n :]
        for (kind, group), rows in pd.DataFrame({"k": self.kinds[: self.n], "g": self.group[: self.n]}).groupby(["k", "g"]).indices.items():
            apart = (groups != group) | (group < 0)
            tests = [(kinds != kind, 1.0)]
            if self.kind[rows[0]] not in ("minimax", "heuristic-rules"):
                tests.append((kinds == kind, 0.0))
            for chosen, distance in tests:
                for among, take in ((chosen, self._spec), (chosen & apart, self.near.meet)):
                    first = among.argmax() if among.any() else None
                    met = rows[self.sequence[rows] > old[first]] if first is not None else rows[:0]
                    take(met, np.full(len(met), distance), np.full(len(met), old[first] if len(met) else 0))

    def _spec(self, rows, distance, at):
        self.spec[rows] = np.minimum(self.spec[rows], distance)

    def distances(self, new, old, later, distance):
        """Take in a matrix of spec distances."""
        if later is not None:
            distance[later] = np.inf
        self._spec(new, distance.min(axis=1), None)
        distance[(self.group[new][:, None] == self.group[old][None, :]) & (self.group[new] >= 0)[:, None]] = np.inf
        nearest = distance.argmin(axis=1)
        least = distance[np.arange(len(new)), nearest]
        met = least < np.inf
        self.near.meet(new[met], least[met], self.sequence[old[nearest[met]]])

    def of_kind(self, kind):
        return np.flatnonzero(np.array([k == kind for k in self.kind], bool))

    def searches(self):
        """Parameters of two searches: of entries with the same ones the first of a block speaks for all."""
        chosen = self.of_kind("minimax")
        number = lambda c: self.both[c].to_numpy()[chosen].astype(float)
        spec = pd.DataFrame({"depth": number("depth"), "epsilon": number("epsilon"), "tie": _codes(self.both["tie_break"])[chosen]}, index=chosen)
        alike = spec.assign(group=self.group[chosen], old=chosen >= self.n).duplicated().to_numpy()
        for new, old, later in self.tiles(chosen[(chosen < self.n) | ~alike]):
            pick = lambda c: (spec.loc[new, c].to_numpy()[:, None], spec.loc[old, c].to_numpy()[None, :])
            (da, db), (ea, eb), (ta, tb) = pick("depth"), pick("epsilon"), pick("tie")
            deepest = np.maximum(da, db)
            depth = np.where(deepest == 0, 0.0, np.abs(da - db) / np.where(deepest == 0, 1, deepest))
            self.distances(new, old, later, np.maximum(np.maximum(depth, np.abs(ea - eb)), np.where(ta != tb, 0.1, 0.0)))

    def rule_sets(self):
        """Jaccard distances of rule sets; only rules seen on both sides can meet."""
        chosen = self.of_kind("heuristic-rules")
        if not len(chosen) or chosen[0] >= self.n or chosen[-1] < self.n:
            return
        rules = self.both["rules"].take(pa.array(chosen)).combine_chunks()
        held = pd.DataFrame({"row": pc.list_parent_indices(rules).to_numpy(), "rule": _codes(pa.chunked_array([rules.flatten()]))}).drop_duplicates()
        size = np.bincount(held["row"], minlength=len(chosen))
        new_side = chosen[held["row"].to_numpy()] < self.n
        shared = np.intersect1d(held["rule"][new_side], held["rule"][~new_side])
        held = held[held["rule"].isin(shared)]
        row, at = held["row"].to_numpy(), np.searchsorted(shared, held["rule"].to_numpy())
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        for new, old, later in self.tiles(chosen):
            i, j = np.searchsorted(chosen, new), np.searchsorted(chosen, old)
            meet = np.zeros((len(new), len(old)), np.int32)
            for start in range(0, len(shared), RULE_BITS):
                part = slice(*np.searchsorted(at, [start, start + RULE_BITS]))
                bits = np.zeros((len(chosen), min(RULE_BITS, len(shared) - start)), bool)
                bits[row[part], at[part] - start] = True
                words = _words(bits)
                meet += _counted((words[i, w][:, None] & words[j, w][None, :] for w in range(words.shape[1])), meet.shape, bits.shape[1])
            either = size[i][:, None] + size[j][None, :] - meet
            empty = either == 0
            either[empty] = 1
            distance = 1.0 - meet / either
            distance[empty] = 0.0
            self.distances(new, old, later, distance)


def _nearest(new, old):
    """Per new entry of one block pair: least distances to the earlier entries of the other block."""
    pair = _Pair(new, old.sort_by("sequence"))
    if len(new) and len(old):
        pair.behaviours()
        pair.fixed()
        pair.searches()
        pair.rule_sets()
    met = np.isfinite(pair.spec) | np.isfinite(pair.near.distance)
    values = [pair.sequence[: pair.n], pair.spec, pair.behaviour, pair.near.distance, pair.near.at]
    return pa.table([v[met] for v in values], names=["sequence", "spec", "behaviour", "best", "nearest"])


def novelty(entries, first_new=0, block_rows=BLOCK_ROWS):
    """Distance of every entry with ``sequence >= first_new`` to the entries before it.

    ``entries`` are the whole archive: sequence (dense from 0), entry_id, kind, depth, epsilon, tie_break,
    rules, sample_id, signature. Distance of a pair is its behaviour distance where comparable, else the
    spec distance. The nearest entry minimises that (ties: earliest); the reported ``distance`` is the
    least behaviour distance if any pair compares, else the least spec distance.

    Entries are cut into blocks of ``block_rows`` sequence numbers, and a block is packed into one value. Each pair of
    a new block and an earlier block is one bounded group that returns one row per new entry, never a row per pair.
    """
    block = F.floor(F.col("sequence") / block_rows).cast("bigint")
    whole = entries.select(
        "sequence", "entry_id", "kind", "depth", "epsilon", "tie_break", "rules", "sample_id", "signature"
    ).withColumn("_b", block)
    new = whole.filter(F.col("sequence") >= first_new)

    def pack(rows):
        return pa.table({"_b": rows["_b"].slice(0, 1), "_data": [_packed(rows.drop_columns(["_b"]))]})

    def compare(cell):
        blobs = dict(zip(cell["_new"].to_pylist(), cell["_data"].to_pylist()))
        tested, prior = (pa.ipc.open_stream(blobs[side]).read_all() for side in (True, False))
        return _nearest(tested.filter(pc.field("sequence") >= first_new), prior)

    blocks = materialize(whole.drop("entry_id").filter("_b is not null").groupBy("_b").applyInArrow(pack, "_b bigint, _data binary"))
    last_block = blocks.agg(F.coalesce(F.max("_b"), F.lit(0))).first()[0]
    old_blocks = F.sequence(F.lit(0).cast("bigint"), F.col("_b"))
    first_block = F.lit(first_new // block_rows).cast("bigint")
    new_blocks = F.sequence(F.greatest(F.col("_b"), first_block), F.lit(last_block))
    tested = blocks.filter(F.col("_b") >= first_block).select("_data", F.lit(True).alias("_new"), F.col("_b").alias("_i"), F.explode(old_blocks).alias("_j"))
    tested = tested.join(blocks.select(F.col("_b").alias("_j")), "_j", "left_semi")
    prior = blocks.filter(F.greatest("_b", first_block) <= F.lit(last_block)).select("_data", F.lit(False).alias("_new"), F.explode(new_blocks).alias("_i"), F.col("_b").alias("_j"))
    prior = prior.join(blocks.select(F.col("_b").alias("_i")), "_i", "left_semi")
    # Few bytes but much work: a task per pair, however small the pairs are.
    pairs = (last_block + 1) * (last_block + 2) // 2
    found = (
        tested.unionByName(prior)
        .repartition(min(2 * pairs, MOST_TASKS), "_i", "_j")
        .groupBy("_i", "_j")
        .applyInArrow(compare, "sequence bigint, spec double, behaviour double, best double, nearest bigint")
        .groupBy("sequence")
        .agg(
            F.min("spec").alias("spec_distance"),
            F.min("behaviour").alias("_behaviour"),
            F.min(F.struct("best", "nearest")).alias("_near"),
        )
    )
    least = F.when(F.col("_behaviour") < float("inf"), F.col("_behaviour"))
    out = new.select("sequence", "entry_id").join(found, "sequence", "left")
    out = out.select(
        "sequence", "entry_id",
        F.col("_near.nearest").alias("nearest_sequence"),
        F.coalesce("spec_distance", F.lit(1.0)).alias("spec_distance"),
        least.alias("behaviour_distance"),
    )
    out = out.withColumn("distance", F.coalesce("behaviour_distance", "spec_distance"))
    return out.withColumn("is_novel", F.col("distance") > 0)


def with_nearest_id(novelties, entries):
    """Add the entry_id of the nearest entry."""
    names = entries.select(F.col("sequence").alias("nearest_sequence"), F.col("entry_id").alias("nearest_entry_id"))
    return novelties.join(names, "nearest_sequence", "left")
