"""Same and near-same records across splits, by joining hashes of canonicalised records.

Records agree in most of their fields if they agree in a whole block of them: with the fields cut into one more
block than may differ, some block agrees in full. Evaluation and training records are therefore joined on the
hash of each canonicalised block, and joined pairs are verified field by field. Equal records are one class, so that
copies are compared once. Where a block value would join too many pairs, the fields not yet agreed on, which can't
hold more differences than before, are cut into as many parts again, and so on until few pairs are left or so many
fields agree that every pair counts. No pair is lost, and frequent values make no crowd of candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.functions.text import category, number, trimmed
from siltstream.operators.eligible import eligible
from siltstream.session import materialise, sized

FIELDS = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts", "flow_byts_s", "flow_pkts_s", "flow_iat_mean", "init_fwd_win_byts", "label"]
AGREE = 12
#: One block more than fields may differ, each with at least one field of many values.
BLOCKS = [
    ["flow_duration", "totlen_fwd_pkts", "src_ip", "protocol"],
    ["flow_byts_s", "totlen_bwd_pkts", "dst_ip", "label"],
    ["flow_pkts_s", "src_port", "tot_fwd_pkts", "init_fwd_win_byts"],
    ["flow_iat_mean", "dst_port", "tot_bwd_pkts"],
]
#: A block value is refined if it would join more pairs than this.
CROWD = 1_000


def canonical_fields(flows: DataFrame) -> DataFrame:
    """flows with the compared fields in canonical form: addresses trimmed, labels and protocols as categories,
    text measures as numbers (null if they are none); NaN becomes null and minus zero zero."""
    kinds = dict(flows.dtypes)

    def form(name: str) -> Column:
        c = F.col(name)
        if name in ("src_ip", "dst_ip"):
            return trimmed(c)
        if name in ("protocol", "label"):
            return category(c)
        if kinds[name] == "string":
            return number(c)
        if kinds[name] in ("double", "float"):
            return F.when(~F.isnan(c), c + F.lit(0.0))
        return c

    return flows.withColumns({f: form(f) for f in FIELDS})


#: Fields of many values, which are spread over the parts of a refinement first.
VARIED = ["flow_duration", "flow_byts_s", "flow_pkts_s", "flow_iat_mean", "totlen_fwd_pkts", "totlen_bwd_pkts", "src_port"]


def _mask(names: list[str]) -> int:
    return sum(1 << FIELDS.index(f) for f in names)


def refined(mask: int) -> list[int]:
    """The masks of the fields that may agree next where those of mask do: one part more than fields may differ. Empty if
    the agreeing fields are enough."""
    parts: list[int] = [0] * (len(FIELDS) - AGREE + 1)
    others = [f for f in [*VARIED, *[f for f in FIELDS if f not in VARIED]] if not mask & _mask([f])]
    if len(others) < len(parts):
        return []
    for i, f in enumerate(others):
        parts[i % len(parts)] |= _mask([f])
    return [mask | p for p in parts]


def _refinements(spark: SparkSession) -> DataFrame:
    """(mask, next): every mask that refining the blocks reaches, with its refinements; some hundred rows, fixed by FIELDS."""
    todo, rows = [_mask(b) for b in BLOCKS], {}
    while todo:
        mask = todo.pop()
        if mask not in rows:
            rows[mask] = refined(mask)
            todo += rows[mask]
    return F.broadcast(spark.createDataFrame(list(rows.items()), "mask int, next array<int>"))


def _block_key(block: int) -> Column:
    names = BLOCKS[block]
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    return F.when(whole, F.xxhash64(F.lit(block), *[F.col(n) for n in names]))


def _mask_key() -> Column:
    """Hash of the fields that a row's mask names, from the hashes of the single fields."""
    named = F.transform("hashes", lambda x, i: F.when(F.call_function("shiftright", F.col("mask"), i).bitwiseAND(1) == 1, x))
    return F.xxhash64("mask", named)


def _shared(keys: DataFrame) -> DataFrame:
    """(key, pairs) of the keys that both sides have. Counted with map-side combining, so a key of any size is one row."""
    counts = keys.groupBy("key").agg(F.count(F.when(F.col("is_eval"), 1)).alias("e"), F.count(F.when(~F.col("is_eval"), 1)).alias("t"))
    return counts.where("e > 0 and t > 0").select("key", (F.col("e") * F.col("t")).alias("pairs"))


def _joined(keys: DataFrame, member: str) -> DataFrame:
    evaluation = keys.where("is_eval").select("key", F.col(member).alias("e"))
    training = keys.where("not is_eval").select("key", F.col(member).alias("t"))
    return training.join(evaluation, "key").select("e", "t")


@dataclass
class Candidates:
    """records: (row_id, is_eval, split, source_file, class, fields) of all that share a block; classes: (class, is_eval,
    fields, hashes, known, n); pairs: (e, t) of classes."""

    records: DataFrame
    classes: DataFrame
    pairs: DataFrame


def _classed(records: DataFrame) -> DataFrame:
    # two hashes of the whole record name its class; null fields are told from values
    whole = [c for f in FIELDS for c in (F.col(f).isNull(), F.col(f))]
    return records.withColumn("class", F.struct(F.xxhash64("is_eval", *whole).alias("a"), F.xxhash64(F.lit(1), "is_eval", *reversed(whole)).alias("b")))


def class_pairs(classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(e, t) of the classes that may agree, those of crowded block values by repeated refinement.

    Only classes whose block value is shared take part; at every step a class stands in as many keys as there are parts,
    and only in keys that still join more than ``crowd`` pairs it goes on."""
    spark = classes.sparkSession
    masks = F.explode(F.array(*[F.lit(_mask(b)) for b in BLOCKS])).alias("mask")
    now = classes.select("class", "is_eval", "hashes", "known", masks)
    made = None
    while True:
        now = now.where(F.col("known").bitwiseAND(F.col("mask")) == F.col("mask")).withColumn("key", _mask_key())
        now = materialise(now, "keyed-classes")
        shared = materialise(_shared(now), "shared-class-keys")
        marked = now.join(sized(shared), "key").join(_refinements(spark), "mask")
        loud = (F.col("pairs") > crowd) & (F.size("next") > 0)
        quiet = _joined(marked.where(~loud), "class")
        made = quiet if made is None else made.unionByName(quiet)
        now = marked.where(loud).select("class", "is_eval", "hashes", "known", F.explode("next").alias("mask"))
        if shared.where(F.col("pairs") > crowd).isEmpty():
            return made


def candidates(records: DataFrame, audit: DataFrame, crowd: int = CROWD) -> Candidates:
    """Every evaluation and training record that agree in a whole block, as pairs of classes; no pair that qualifies is
    missing."""
    blocks = F.array(*[F.struct(_block_key(b).alias("key")) for b in range(len(BLOCKS))])
    first = records.select("row_id", "is_eval", F.inline(blocks)).where("key is not null")
    # few keys are on both sides; the rows of all others stay where they are
    shared = materialise(_shared(first), "shared-keys")
    ids = materialise(first.join(sized(shared.select("key")), "key", "left_semi").select("row_id").distinct(), "candidate-ids")
    # the audit is held against the few candidates, not against all of flows
    known = _classed(eligible(records.join(sized(ids), "row_id", "left_semi"), audit))
    known = materialise(known.select("row_id", "is_eval", "split", "source_file", "class", *FIELDS), "candidate-records")
    one = known.groupBy("class").agg(F.first("is_eval").alias("is_eval"), F.count(F.lit(1)).alias("n"), *[F.first(f).alias(f) for f in FIELDS])
    single = F.array(*[F.when(F.col(f).isNotNull(), F.xxhash64(F.lit(i), f)) for i, f in enumerate(FIELDS)])
    present = F.lit(0)
    for i, f in enumerate(FIELDS):
        present = present + F.when(F.col(f).isNotNull(), 1 << i).otherwise(0)
    classes = materialise(one.withColumns({"hashes": single, "known": present}), "candidate-classes")
    return Candidates(known, classes, materialise(class_pairs(classes, crowd).distinct(), "candidate-pairs"))


def _agreeing() -> Column:
    same = [F.coalesce((F.col(f"a.{f}") == F.col(f"b.{f}")).cast("int"), F.lit(0)) for f in FIELDS]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total


def _found(flows: DataFrame, audit: DataFrame, crowd: int) -> tuple[Candidates, DataFrame]:
    """The candidates, and (e, t, agree, n_e, n_t) of the pairs of classes that agree in at least AGREE fields."""
    split = F.lower(trimmed(F.col("split")))
    records = flows.withColumn("split", split).where(split.isin("train", "validation", "test"))
    records = canonical_fields(records.select("row_id", "source_file", "source_row", "split", *FIELDS)).withColumn("is_eval", F.col("split") != "train")
    found = candidates(records, audit, crowd)
    side = sized(found.classes.select("class", "n", *FIELDS))
    both = found.pairs.join(side.alias("a"), F.col("e") == F.col("a.class")).join(side.alias("b"), F.col("t") == F.col("b.class"))
    agreed = both.withColumn("agree", _agreeing()).where(F.col("agree") >= AGREE)
    return found, agreed.select("e", "t", "agree", F.col("a.n").alias("n_e"), F.col("b.n").alias("n_t"))


def overlaps(flows: DataFrame, audit: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(e, t, agree, split, source_file, train_file): every eligible validation or test record e and eligible train
    record t that agree in at least AGREE fields. Null agrees with nothing. Splits compare trimmed, ignoring case;
    rows of another or no split are left out. Copies all count. Empty in, empty out."""
    found, agreed = _found(flows, audit, crowd)
    evaluation = found.records.where("is_eval").select(F.col("class").alias("e"), F.col("row_id").alias("e_id"), "split", "source_file")
    training = found.records.where("not is_eval").select(F.col("class").alias("t"), F.col("row_id").alias("t_id"), F.col("source_file").alias("train_file"))
    rows = agreed.join(evaluation, "e").join(training, "t")
    return rows.select(F.col("e_id").alias("e"), F.col("t_id").alias("t"), "agree", "split", "source_file", "train_file")


def overlap_pairs(flows: DataFrame, audit: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b), the smaller first."""
    found = overlaps(flows, audit)
    return found.select(F.least("e", "t").alias("row_id_a"), F.greatest("e", "t").alias("row_id_b"))


def overlap_report(flows: DataFrame, audit: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Per split and source_file of the evaluation records: pairs, pairs that agree in all fields, evaluation and
    training records involved. Counted from classes; no copies are expanded into pairs."""
    found, agreed = _found(flows, audit, crowd)
    key = ["split", "source_file"]
    members = found.records.where("is_eval").groupBy(F.col("class").alias("e"), *key).agg(F.count(F.lit(1)).alias("m"))
    placed = materialise(agreed.join(members, "e"), "class-overlaps")
    pairs = placed.groupBy(*key).agg(F.sum(F.col("m") * F.col("n_t")).alias("n_pairs"), F.sum(F.when(F.col("agree") == len(FIELDS), F.col("m") * F.col("n_t")).otherwise(0)).alias("n_exact_pairs"))
    once = lambda c, n: placed.select(*key, c, n).distinct().groupBy(*key).agg(F.sum(n).alias("k"))
    # null files are a group too
    named = lambda df, name: df.select(F.struct(*key).alias("k_"), F.col("k").alias(name))
    whole = pairs.withColumn("k_", F.struct(*key)).join(named(once("e", "m"), "n_eval_records"), "k_").join(named(once("t", "n_t"), "n_train_records"), "k_")
    return whole.select(*key, "n_pairs", "n_exact_pairs", "n_eval_records", "n_train_records")
