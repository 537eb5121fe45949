"""Conflict rules between new and stored memories, routing, and what a resolution changes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.functions import values as C
from cairn.sources.shared import settle

#: Bits of the sketch of a set of words, and places of the table of ids whose words are needed.
SKETCH, MARKS = 512, 1 << 23
#: Characters around an alias in which the words of a claim are looked for first.
NEAR = 256
_CHANGES = "array<struct<kind:string,id:string,other:string,what:string>>"
_CLAIMS = "array<struct<subject:string,verb:string,object:string>>"
THRESHOLDS = {"similarity": 0.45, "supersede": 0.92, "duplicate": 0.95, "complement": 0.80, "expiry_secs": 300, "top_k": 5}


def _contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(p)) for p in parts))


def supersede_signal(text: Column | str) -> Column:
    return _contains_any(F.lower(X.col(text)), C.SUPERSEDE_SIGNALS)


def negation(new: Column | str, old: Column | str) -> Column:
    """One text has the negative of a pair, the other its positive alone."""
    n, o = F.lower(X.col(new)), F.lower(X.col(old))
    one = lambda a, b, pos, neg: F.contains(a, F.lit(neg)) & F.contains(b, F.lit(pos)) & ~F.contains(b, F.lit(neg))
    return reduce(Column.__or__, (one(n, o, p, q) | one(o, n, p, q) for p, q in C.NEGATION_PAIRS))


def claims(text: Column | str) -> Column:
    """(subject, verb, object) around the first place of each alias of a verb: the word before it, and the first of more than one byte after it."""
    return _claims(F.lower(X.col(text)))


def _claims(lowered: Column) -> Column:
    """``claims`` of a text in small letters; words are looked for near the alias, and in the whole text where none ends there."""

    def first(near: Column, pattern: str, whole: Column) -> Column:
        word = F.regexp_extract(near, rf"(?U)^\s*+{pattern and pattern + '*+'}(\S++)\s", 1)
        return X.once(word, lambda w: F.when(w != "", w).otherwise(F.regexp_extract(whole, rf"(?U)^\s*{pattern and pattern + '*'}(\S+)", 1)))

    def claim(low: Column, at: Column, verb: str, alias: str) -> Column:
        near = F.reverse(F.substring(low, F.greatest(at - NEAR, F.lit(1)), F.least(at - 1, F.lit(NEAR))))
        subject = F.reverse(first(near, "", F.reverse(F.substring(low, F.lit(1), at - 1))))
        start = at + len(alias)
        word = first(F.substring(low, start, F.lit(NEAR)), r"(?:[\x00-\x7F&&\S]\s+)", F.substring(low, start, F.char_length(low)))
        return F.struct(subject.alias("subject"), F.lit(verb).alias("verb"), X.bare(F.when(F.octet_length(word) > 1, word).otherwise("")).alias("object"))

    def at_first(low: Column, verb: str, alias: str) -> Column:
        return F.transform(F.array(F.when(F.contains(low, F.lit(alias)), F.locate(alias, low))), lambda at: F.when(at > 0, claim(low, at, verb, alias)))

    def found(low: Column) -> Column:
        every = F.concat(*(at_first(low, verb, alias) for verb, aliases in C.CLAIM_VERBS for alias in aliases))
        return F.filter(every, lambda c: c.isNotNull() & (c["subject"] != "") & (c["object"] != ""))

    return F.transform(F.array(lowered), found)[0].cast(_CLAIMS)


def differing(mine: Column, theirs: Column) -> Column:
    """How the first of two lists' claims of one subject and verb differ, or null."""
    pairs = F.flatten(F.transform(mine, lambda n: F.transform(theirs, lambda o: F.struct(n.alias("n"), o.alias("o")))))
    same = F.filter(pairs, lambda p: (p["n"]["subject"] == p["o"]["subject"]) & (p["n"]["verb"] == p["o"]["verb"]) & (p["n"]["object"] != p["o"]["object"]))
    told = lambda p: F.concat(p["n"]["subject"], F.lit(" "), p["n"]["verb"], F.lit(" '"), p["o"]["object"], F.lit("' vs '"), p["n"]["object"], F.lit("'"))
    return F.get(F.transform(F.slice(same, 1, 1), told), F.lit(0))


def competing(new: Column | str, old: Column | str) -> Column:
    """How the first claims of one subject and verb in two texts differ, or null; each text's claims are found once."""
    both = F.array(F.struct(claims(new).alias("n"), claims(old).alias("o")))
    return F.transform(both, lambda x: differing(x["n"], x["o"]))[0]


def rule(new: str = "new", old: str = "old", difference: Column | None = None) -> Column:
    """The first rule that holds for two struct columns (compressed, content, author, created_at), or null; ``difference`` of their claims if it is known."""
    n, o = F.col(new), F.col(old)
    difference = competing(n["content"], o["content"]) if difference is None else difference
    newer = (n["author"] == o["author"]) & (n["created_at"] >= o["created_at"])
    return first_rule(X.similarity(n["compressed"], o["compressed"]) > C.DUPLICATE_ABOVE, newer & supersede_signal(n["content"]), negation(n["content"], o["content"]), difference)


def first_rule(duplicate: Column, superseded: Column, negated: Column, difference: Column) -> Column:
    """The verdict of the first rule that holds, or null."""

    def verdict(number: int, relation: str, confidence: float, action: str, why: str, what: Column | None = None) -> Column:
        key = what if what is not None else F.lit(None).cast("string")
        return F.struct(F.lit(number).alias("rule"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), F.lit(why).alias("reasoning"), key.alias("key_difference"), F.lit(action).alias("suggested_action"), F.lit(1).alias("tier"))

    r = C.RULE_CONFIDENCE
    out = F.when(duplicate, verdict(1, "duplicate", r["duplicate"], "skip", "near-identical to an existing memory"))
    out = out.when(superseded, verdict(2, "supersede", r["supersede"], "replace", "the same author signals a change"))
    out = out.when(negated, verdict(3, "contradicts", r["contradicts"], "ask_user", "negates an existing claim"))
    return out.when(difference.isNotNull(), verdict(4, "supersede", r["competing"], "ask_user", "the same subject with another value", difference))


def analyze(pairs: DataFrame) -> DataFrame:
    """Of pairs (new, old structs with id; rank of the candidate) the first candidate with a rule, for each new memory."""
    told = pairs.withColumn("_difference", competing("new.content", "old.content"))
    return first_verdicts(told.withColumn("verdict", rule(difference=F.col("_difference"))))


def first_verdicts(judged: DataFrame) -> DataFrame:
    """The first candidate with a verdict, for each new memory."""
    first = judged.filter("verdict is not null").groupBy(F.col("new.id").alias("new_id")).agg(F.min_by(F.struct("new", "old", "verdict"), F.struct("rank", "old.id")).alias("x"))
    return first.select("new_id", F.col("x.old.id").alias("existing_id"), "x.verdict.*", F.col("x.new").alias("new"), F.col("x.old").alias("old"))


def auto_resolution(thresholds: dict | None = None, judge: Column | None = None) -> Column:
    """What resolves a verdict at once, or null for review; contradictions are always reviewed."""
    t = THRESHOLDS | (thresholds or {})
    relation, confidence = F.col("relation"), F.col("confidence")
    out = F.when((relation == "duplicate") & (confidence >= t["duplicate"]), "discard_new")
    out = out.when((relation == "complementary") & (confidence >= t["complement"]), "keep_both")
    return out.when((relation == "supersede") & (confidence >= t["supersede"]) & (F.col("new.author") == F.col("old.author")), "replace")


def expiry(created: Column | str, seconds: int = 300) -> Column:
    return X.col(created) + F.make_interval(secs=F.lit(float(seconds)))


def facts(memories: DataFrame, words: Column | None = None) -> DataFrame:
    """What the rules need of each memory (id, author, created_at, state, content, compressed): signals, claims, and of the set of its words the size, a sketch, and the digest in the order they come.

    ``words`` are the distinct words of the compressed form where that is not at hand.
    """

    @F.arrow_udf("array<bigint>")
    def sketch(hashes: pa.Array) -> pa.Array:
        n = np.asarray(hashes.value_lengths().fill_null(0)).astype(np.int64)
        at = np.repeat(np.arange(len(n)), n) * SKETCH + np.asarray(hashes.flatten()).astype(np.int64) % SKETCH
        odd = (np.bincount(at, minlength=len(n) * SKETCH) & 1).astype(np.uint8)
        flat = pa.array(np.packbits(odd).view(np.int64))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (SKETCH // 64), pa.int32()), flat)

    low = F.col("_low")  # consumed more than once, so the planner keeps it apart
    bits = lambda parts: reduce(Column.__add__, (F.contains(low, F.lit(p)).cast("int") * (1 << i) for i, p in enumerate(parts)))
    yes, no = (bits([pair[i] for pair in C.NEGATION_PAIRS]) for i in (0, 1))
    rows = memories.withColumn("_low", F.lower("content")).select("id", "author", "created_at", "state", _contains_any(low, C.SUPERSEDE_SIGNALS).alias("signal"), yes.alias("yes"), no.alias("no"), _claims(low).alias("claims"), (F.array_distinct(X.words("compressed")) if words is None else words).alias("_w"))
    set_ = F.col("_w")
    rows = rows.withColumns({"size": F.size(set_), "digest": F.unhex(F.sha2(F.array_join(set_, " "), 256)), "sketch": sketch(F.transform(set_, lambda w: F.xxhash64(w)))})
    return rows.drop("_w")


def candidates(near: DataFrame, new: DataFrame, existing: DataFrame) -> DataFrame:
    """Of pairs (query_id, id, rank) of new memories and live stored ones, by the ``facts`` of both: new and old (id, author), what the rules tell but for near-identical words, and whether these are ``same`` or may be ``alike``."""
    side = lambda df, key, name: df.select(F.col("id").alias(key), F.struct(*[c for c in df.columns if c != "state"]).alias(name))
    live = existing.filter(F.col("state").isin("active", "disputed"))
    pairs = near.select("query_id", "id", "rank").join(side(new, "query_id", "n"), "query_id").join(side(live, "id", "o"), "id")
    n, o = F.col("n"), F.col("o")
    total = n["size"] + o["size"]
    bits = reduce(Column.__add__, (F.bit_count(F.get(n["sketch"], F.lit(i)).bitwiseXOR(F.get(o["sketch"], F.lit(i)))) for i in range(SKETCH // 64)))
    apart = F.greatest(F.abs(n["size"] - o["size"]), bits)  # words that one of the sets alone has, at least
    alike = (total - apart) > C.DUPLICATE_ABOVE * (total + apart) - 1e-6
    clear = lambda a, b: a["no"].bitwiseAND(b["yes"]).bitwiseAND(F.bitwise_not(b["no"]))
    return pairs.select(
        F.struct(n["id"].alias("id"), n["author"].alias("author")).alias("new"), F.struct(o["id"].alias("id"), o["author"].alias("author")).alias("old"), "rank",
        ((n["author"] == o["author"]) & (n["created_at"] >= o["created_at"]) & n["signal"]).alias("superseded"), (clear(n, o).bitwiseOR(clear(o, n)) != 0).alias("negated"),
        differing(n["claims"], o["claims"]).alias("difference"), (n["digest"] == o["digest"]).alias("same"), alike.alias("alike"),
    )


def judged(pairs: DataFrame, new_words: DataFrame, old_words: DataFrame) -> DataFrame:
    """The candidates with their verdicts, up to the first that is sure; ``new_words`` and ``old_words`` (id, words) give the distinct words of compressed texts.

    Words are compared only for pairs whose sketches allow the threshold and that no sure verdict of an earlier candidate makes idle.
    """
    sure = F.col("same") | F.col("superseded") | F.col("negated") | F.col("difference").isNotNull()
    first = F.min(F.when(sure, F.col("rank"))).over(Window.partitionBy("new.id"))
    pairs = settle(pairs.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col("rank") <= F.col("_first"))).drop("_first"))
    open_ = pairs.filter(F.col("alike") & ~F.coalesce("same", F.lit(False))).select(F.col("new.id").alias("n"), F.col("old.id").alias("o"))
    joined = lambda df, ids, key, name: among(df, ids).select(F.col("id").alias(key), F.array_join("words", " ").alias(name))
    both = open_.join(joined(old_words, open_.select(F.col("o").alias("id")), "o", "ow"), "o").join(joined(new_words, open_.select(F.col("n").alias("id")), "n", "nw"), "n")
    apart = both.select("n", "o", *(F.split(c, " ").alias(c) for c in ("nw", "ow")))  # distinct words; two sets without words are the same
    common = F.size(F.array_intersect("nw", "ow")).cast("double")
    equal = apart.filter(common / (F.size("nw") + F.size("ow") - common) > C.DUPLICATE_ABOVE).select("n", "o", F.lit(True).alias("equal"))
    told = pairs.join(equal, (F.col("new.id") == F.col("n")) & (F.col("old.id") == F.col("o")), "left")
    duplicate = F.coalesce("same", F.lit(False)) | F.coalesce("equal", F.lit(False))
    return told.withColumn("verdict", first_rule(duplicate, F.col("superseded"), F.col("negated"), F.col("difference"))).select("new", "old", "rank", "verdict")


def among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with one of the ids, and few others: a table of places of hashes tells them before anything is made of them or shuffled."""
    place = lambda: F.pmod(F.xxhash64("id"), F.lit(MARKS)).cast("int")
    places = ids.select(place().alias("m")).distinct().toArrow()["m"].to_numpy()  # MARKS numbers at most
    marks = np.zeros(MARKS, bool)
    marks[places] = True
    known = df.sparkSession.sparkContext.broadcast(np.packbits(marks).tobytes())

    @F.arrow_udf("boolean")
    def marked(places: pa.Array) -> pa.Array:
        at = np.asarray(places).astype(np.int64)
        return pa.array((np.frombuffer(known.value, np.uint8)[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    return df.filter(marked(place()))


def route(near: DataFrame, new: DataFrame, existing: DataFrame, new_words: DataFrame, old_words: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """id and outcome of each new memory by its nearest stored ones (query_id, id, rank) and the ``facts`` of both sides: stored, auto_resolved (with the resolution) or conflict (pending); with the verdict."""
    pairs = settle(candidates(near, new, existing))
    verdicts = first_verdicts(judged(pairs, new_words, old_words)).withColumn("resolution", auto_resolution(thresholds)).drop("new", "old")
    every = pairs.groupBy(F.col("new.id").alias("new_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("old.id").alias("id")))), lambda x: x["id"]).alias("candidate_ids"))
    routed = new.select("id").join(verdicts, F.col("id") == F.col("new_id"), "left").drop("new_id").join(every, F.col("id") == F.col("new_id"), "left").drop("new_id")
    outcome = F.when(F.col("relation").isNull(), "stored").when(F.col("resolution").isNotNull(), "auto_resolved").otherwise("conflict")
    return routed.withColumn("outcome", outcome)


def resolution_changes(decided: DataFrame) -> DataFrame:
    """What decisions (conflict_id, action, new_id, merged_id, existing_ids) change: rows of conflict_id, kind, id, other and what.

    ``stands``: the id that stands for the conflict; ``added``: a memory of the new text (or of the merged one); ``superseded``: an old
    memory; ``edge``: from the one that stands to an old one, and its type; ``event``: a memory's timeline. A decision is told by its own row.
    """
    action, old = F.col("action"), F.coalesce("existing_ids", F.array().cast("array<string>"))
    stands = F.when(action == "discard_new", F.get(old, F.lit(0))).when(action == "merge", F.col("merged_id")).otherwise(F.col("new_id"))
    none = F.lit(None).cast("string")

    def change(kind: str, id_: Column, other: Column = none, what: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), id_.cast("string").alias("id"), other.cast("string").alias("other"), what.cast("string").alias("what"))

    some = lambda held, *changes: F.when(held, F.array(*changes)).otherwise(F.array().cast(_CHANGES))
    each = lambda held, made: F.when(held, F.transform(old, made)).otherwise(F.array().cast(_CHANGES))
    takes_over, kept = action.isin("replace", "merge"), action != "discard_new"
    changes = F.concat(
        F.array(change("stands", stands)), some(kept, change("added", stands), change("event", stands, what=F.lit("created"))), some(~kept, change("event", stands, what=F.lit("refreshed"))),
        each(takes_over, lambda x: change("superseded", x)), each(takes_over, lambda x: change("edge", stands, x, F.lit("supersedes"))), each(action == "keep_both", lambda x: change("edge", stands, x, F.lit("complements"))),
        each(action == "replace", lambda x: change("event", x, stands, F.lit("superseded"))),
    )
    return decided.select("conflict_id", F.explode(changes).alias("c")).select("conflict_id", "c.*")


def endorse(memories: DataFrame, votes: DataFrame, as_of: str) -> DataFrame:
    """Adds the authors of votes (id, author) to endorsed_by, and recomputes the confidence; the state stays."""
    given = votes.groupBy("id").agg(F.array_sort(F.collect_set("author")).alias("_new"))
    rows = memories.join(given, "id", "left").withColumn("_new", F.coalesce("_new", F.array().cast("array<string>")))
    rows = rows.withColumn("endorsed_by", F.array_union("endorsed_by", "_new"))
    hit = F.size("_new") > 0
    rows = rows.withColumn("confidence", F.when(hit, X.consensus(F.size("endorsed_by"), F.size("disputed_by"))).otherwise(F.col("confidence")))
    return rows.withColumn("verified_at", F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("verified_at"))).drop("_new")


def dispute(memories: DataFrame, votes: DataFrame) -> DataFrame:
    """Adds the authors of votes to disputed_by; a memory with as many disputes as endorsements, one at least, is disputed."""
    given = votes.groupBy("id").agg(F.array_sort(F.collect_set("author")).alias("_new"))
    rows = memories.join(given, "id", "left").withColumn("_new", F.coalesce("_new", F.array().cast("array<string>")))
    rows = rows.withColumn("disputed_by", F.array_union("disputed_by", "_new"))
    hit = F.size("_new") > 0
    flips = hit & (F.size("disputed_by") >= F.greatest(F.size("endorsed_by"), F.lit(1)))
    rows = rows.withColumn("state", F.when(flips, "disputed").otherwise(F.col("state")))
    return rows.withColumn("confidence", F.when(hit, X.consensus(F.size("endorsed_by"), F.size("disputed_by"))).otherwise(F.col("confidence"))).drop("_new")


def expire(conflicts: DataFrame, as_of: str) -> DataFrame:
    """Pending conflicts whose time is over become expired."""
    over = (F.col("state") == "pending") & (F.col("expires_at") <= F.lit(as_of).cast("timestamp"))
    return conflicts.withColumn("state", F.when(over, "expired").otherwise(F.col("state")))


def newest_first(df: DataFrame, key: str, most: int, when: str = "created_at", tie: str = "id") -> DataFrame:
    """The latest ``most`` rows of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(when), F.desc(tie))
    return df.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
