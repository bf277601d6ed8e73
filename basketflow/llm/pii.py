"""Personal data in whole texts: fixed rules, and bootstrapped contextual extraction on top.

The rules' matches are the seeds. Each seed and each weaker candidate (something shaped like an address
or a number that the rules don't take) has lexical patterns: the words around it. Spark keeps the graph
of patterns and instances (distinct strings, so copies of a document add nothing) and scores it in turns:
a pattern by the share of its instances that are believed, a candidate by the patterns that hold it.
Patterns that end above `CONFIDENT` with at least `SUPPORT` different seeds name the candidates in their
slot as further spans. The rules' spans always stay.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import set_aside, stored, table

KINDS = ("email", "ip", "card", "phone")
TURNS = 3
SUPPORT = 3
CONFIDENT = 0.6
#: what an unbelieved candidate counts against its pattern
DOUBT = 0.5
#: characters around a span that its words are taken from
AROUND = 80

# fixed values: the rules of the task
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: weaker shapes, only believed in a believed context
AT, DOT = r"(?:\s?(?:@|\[at\]|\(at\))\s?|\sat\s)", r"(?:\.|\s?(?:\[dot\]|\(dot\))\s?|\sdot\s)"
WEAK_EMAIL = re.compile(rf"(?<![\w.%+-])[\w.%+-]{{1,64}}(?:{AT}[\w-]{{1,63}}(?:{DOT}[\w-]{{1,63}}){{1,5}}|@[\w-]{{1,63}})", re.I)
SPELLED = re.compile(r"[\[(](?:at|dot)[\])]|\bdot\b", re.I)
WEAK_IP = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w.])")
WEAK_NUMBER = re.compile(r"(?<![\w.+])\(?[0-9](?:[\x20()./-]{0,2}[0-9])+(?!\w)")
WORD = re.compile(r"\S+")


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of the address rule, in linear time: an address needs an @ with a domain
    behind it, and reaches left as far as the local part's characters and the last match allow."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last if m else 0))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    got = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            got.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            got.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                got.append(("phone", *m.span()))
    return sorted(got, key=lambda x: (x[1], KINDS.index(x[0])))


def candidate_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weaker shapes that overlap no rule's span and no candidate before them."""
    found = []
    if "@" in text or SPELLED.search(text):
        found += [("email", *m.span()) for m in WEAK_EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in WEAK_IP.finditer(text)]
    for m in WEAK_NUMBER.finditer(text):
        n = len(_digits(m.group()))
        if 7 <= n <= 19:
            found.append(("card" if n >= 13 else "phone", *m.span()))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    out, taken, i = [], 0, 0
    for kind, a, b in found:
        while i < len(base) and base[i][2] <= a:
            i += 1
        if a >= taken and not any(x[1] < b and x[2] > a for x in base[i:i + 4]):
            out.append((kind, a, b))
            taken = b
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """The words around a span, digits as 0: two before; one before and one behind; a label before."""
    left = re.sub("[0-9]", "0", text[max(0, start - AROUND):start].lower()).split()
    right = re.sub("[0-9]", "0", text[end:end + AROUND].lower()).split()
    out = []
    if len(left) >= 2:
        out.append(f"{left[-2]} {left[-1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    if left and left[-1][-1] in ":=#":
        out.append(f"{left[-1]} _")
    return out


SCANNED = "doc_id long, text_key long, base array<struct<kind:string,start:long,end:long,instance:string,patterns:array<string>>>, weak array<struct<kind:string,start:long,end:long,instance:string,patterns:array<string>>>, base_sha256 string"
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])


def _scan(batches):
    for batch in batches:
        base_out, weak_out, digest = [], [], []
        for x in batch.column(2):
            text = x.as_py() or ""
            base = base_spans(text)
            cols = []
            for spans in (base, candidate_spans(text, base)):
                cols.append([(k, a, b, text[a:b].lower(), patterns(text, a, b)) for k, a, b in spans])
            base_out.append(cols[0])
            weak_out.append(cols[1])
            digest.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
        struct = lambda rows: pa.array([[dict(zip(("kind", "start", "end", "instance", "patterns"), s)) for s in r] for r in rows], pa.list_(SPAN))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), struct(base_out), struct(weak_out), pa.array(digest, pa.string())], names=["doc_id", "text_key", "base", "weak", "base_sha256"])


def scan(docs: DataFrame) -> DataFrame:
    """Rule spans and candidates of every row of ``docs`` (doc_id, text); null texts are empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(_scan, SCANNED)


def believed_patterns(scanned: DataFrame) -> DataFrame:
    """pattern, kind, score of the patterns that end confident."""
    def edges(column: str, seed: bool) -> DataFrame:
        s = scanned.select(F.explode(column).alias("s")).select("s.kind", F.xxhash64("s.instance").alias("instance"), F.explode("s.patterns").alias("pattern"))
        return s.withColumn("seed", F.lit(seed))

    graph = edges("base", True).unionByName(edges("weak", False)).distinct()
    seeded = graph.filter("seed").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= SUPPORT)
    graph = stored(graph.join(seeded.select("pattern").distinct(), "pattern", "left_semi"), "graph")
    belief = graph.filter("not seed").select("kind", "instance").distinct().withColumn("belief", F.lit(0.0))
    scores = None
    for _ in range(TURNS):
        held = graph.join(belief, ["kind", "instance"], "left")
        worth = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("belief", F.lit(0.0)))
        against = F.when(F.col("seed"), 1.0).otherwise(F.greatest(F.lit(DOUBT), worth))
        by_kind = held.groupBy("pattern", "kind").agg(F.sum(worth).alias("for"), F.sum(against).alias("against"), F.sum(F.col("seed").cast("long")).alias("support"))
        total = by_kind.groupBy("pattern").agg(F.sum("against").alias("all"))
        scores = by_kind.join(total, "pattern").filter(F.col("support") >= SUPPORT).select("pattern", "kind", (F.col("for") / (F.col("all") + 1)).alias("score"))
        scores = stored(scores, "scores")
        belief = graph.filter("not seed").join(scores, ["pattern", "kind"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("belief"))
    return scores.filter(F.col("score") >= CONFIDENT)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_email, n_ip, n_card, n_phone, base_sha256 and all spans (array of start,
    place of the kind in `KINDS`, end, kind) for every row of ``docs``.

    Null and empty texts have no spans. Repeated rows give repeated results."""
    scanned = stored(scan(docs), "scanned")
    good = believed_patterns(scanned).select("pattern", F.col("kind").alias("kind"))
    weak = scanned.filter(F.size("weak") > 0).select("doc_id", "text_key", F.explode("weak").alias("s")).select("doc_id", "text_key", "s.kind", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    more = weak.join(good, ["pattern", "kind"], "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    more = more.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "more")
    row = scanned.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    place = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    ordered = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.array_sort(F.concat(ordered("base"), F.coalesce(ordered("more"), F.array().cast("array<struct<start:bigint,place:bigint,end:bigint,kind:string>>"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return row.select("doc_id", "text_key", *[count(k) for k in KINDS], "base_sha256", spans.alias("spans"))


def op1_bootstrapped_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", text.alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by the kind in brackets; overlapping spans are
    replaced as one, under the first one's kind. n_chars, where present, follows the new text."""
    docs, names = set_aside(docs, "spans", "_id", "_key", "_key0")
    found = find(docs.select("doc_id", "text")).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans")
    joined = docs.withColumn("_key0", F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key0") == F.col("_key")), "left")
    # cut from the left: `at` is how far the text is copied
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
        F.concat(acc["out"], F.substr("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].cast("int").alias("at"))).otherwise(
        F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"].cast("int")).alias("at")))
    new = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1)))
    out = joined.withColumn("text", F.when(F.col("spans").isNotNull(), new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns).withColumnsRenamed(names)
