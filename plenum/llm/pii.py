"""Personal data: patterns propose spans, checksums confirm them, context moves their score.

Kinds `email`, `ip`, `card` (Luhn) and `phone` are the base. `iban` (mod 97),
`routing` (bank routing numbers, weighted mod 10), `ssn`, `birth` (dates) and
`secret` (keys and tokens) are added. A span is reported when its score reaches
`ACCEPT`. Base spans that pass their check score at least that much without any
context. Words nearby move the score of any span: those that name its kind
raise it, those that mark samples lower that of added kinds. So an IBAN stands
on its checksum unless called an example, and the other added kinds need to be
named. `NEAR` code points before and after a span count, as far as no other
match of the kind lies there. Spans are in code points, end exclusive, leftmost
and non-overlapping within a kind; a match that fails its check is dropped
without another try inside it, but for `iban`: of its 15 to 34 letters and
digits, the longest that ends with a word and passes counts. Redaction replaces
the union of the spans, so that overlapping kinds are replaced once.

All work is done with SQL functions. The pieces between matches and the
matches themselves come from one split and one extraction with the same
pattern, and their summed lengths, by blocks, are the positions. Patterns are written with
possessive repetition and a look at the character before, so that each is
linear in the length of the text.

Nulls: a null text is empty and has no spans (redaction leaves it null).
Very long texts are searched whole. Repeated rows are handled one by one; an
empty table gives an empty result. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, table

#: Fixed patterns. `(?:\G|(?<!x))` starts a run where the last match ended or where no run can have begun earlier.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",
    "routing": r"(?<![0-9A-Za-z.-])[0-9]{9}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "birth": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9/-])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,40}[0-9])[A-Za-z0-9_+/-]{16,}+=*",
}
#: What a text must hold for a kind to be possible at all; cheap to test.
HINTS = {
    "email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "routing": r"[0-9]{9}", "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "birth": r"[0-9][./-][0-9]{1,2}[./-][0-9]", "secret": r"(?i)token|secret|passw|key|credential|bearer",
}
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "routing", "ssn", "birth", "secret")
#: Score of a span whose check passed, and what context words nearby add or take.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "routing": 0.3, "ssn": 0.3, "birth": 0.2, "secret": 0.3}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write)\b", "ip": r"(?i)\b(?:ip|address|host|server)\b", "card": r"(?i)\b(?:card|visa|mastercard|credit|cvv)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b", "iban": r"(?i)\b(?:iban|account|bank)\b", "routing": r"(?i)\b(?:routing|aba|rtn|bank)\b", "ssn": r"(?i)\b(?:ssn|social|security)\b",
    "birth": r"(?i)\b(?:born|birth|birthday|dob|geboren|nacido|nacida|née?)\b", "secret": r"(?i)(?:token|secret|passw(?:or)?d|credential|bearer|api[_\x20-]?key|access[_\x20-]?key|private[_\x20-]?key|\bkey)\b",
}
SAMPLE = r"(?i)\b(?:example|sample|dummy|fake|placeholder)\b"
BOOST = 0.3
ACCEPT = 0.5
NEAR = 40
#: Items of an array that are handled together.
BLOCK = 128
#: Code points that an IBAN has at most beyond its first four: 30, with a space before each and between each two groups.
REST = 63


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The digits from the right, every second one doubled and reduced to one digit, sum to a multiple of 10."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def _scan(items: Column, begin: Column, out: str, step, emit) -> Column:
    """The array of what emit makes of the state so far and each item; step gives the next state, out is the array's type.

    Blocks of `BLOCK` items are gathered one by one, so that appending to an
    array costs no more than a block for each item.
    """
    def block(a: Column, part: Column) -> Column:
        none = F.array().cast(out)
        return F.aggregate(part, F.struct(a["s"].alias("s"), a["done"].alias("done"), none.alias("now")), lambda b, x: F.struct(step(b["s"], x).alias("s"), b["done"].alias("done"), F.concat(b["now"], F.array(emit(b["s"], x))).alias("now")), lambda b: F.struct(b["s"].alias("s"), F.concat(b["done"], F.array(b["now"])).alias("done")))

    return _bound(items, lambda known: F.aggregate(_blocks(known), F.struct(begin.alias("s"), F.array().cast(f"array<{out}>").alias("done")), block, lambda a: F.flatten(a["done"])))


def _blocks(items: Column) -> Column:
    """The array cut into arrays of `BLOCK`; null stays null."""
    return F.when(items.isNotNull(), F.transform(F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>")), lambda j: F.slice(items, j * BLOCK + 1, BLOCK)))


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return ~F.exists(F.split(m, r"\."), lambda p: (F.length(part(p)) > 3) | (F.lpad(part(p), 3, "0") > "255"))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "routing":
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.substring(m, i, F.lit(1)).cast("int") * F.element_at(F.array(F.lit(3), F.lit(7), F.lit(1)), (i - 1) % 3 + 1)), F.lit(0), lambda a, x: a + x) % 10 == 0
    if kind == "secret":
        # letters and digits mixed, and not one character over and over
        return m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= 8)
    return F.lit(True)


def _located(df: DataFrame, kind: str) -> DataFrame:
    """df plus __p_<kind>: all matches of the kind in __p_t (m), the code point where each begins (b) and the text on both sides (l, r); null where the hint is absent.

    Ends are running sums of the lengths of gaps and matches: over blocks, and
    inside each block from its offset.
    """
    gaps, found, steps, offsets = (f"__p_{kind}_{x}" for x in ("gaps", "found", "steps", "offsets"))
    add = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    t, possible = F.col("__p_t"), F.col("__p_t").rlike(HINTS[kind])
    df = df.withColumns({gaps: F.when(possible, F.split(t, PATTERNS[kind], -1)), found: F.when(possible, F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0)))})
    # bound: the optimizer may put the split itself where a lambda names its column once
    df = df.withColumn(steps, _bound(F.col(gaps), lambda g: F.transform(found, lambda m, i: F.length(m) + F.length(F.get(g, i)))))
    blocks = F.when(F.size(steps) > 0, F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))).when(F.col(steps).isNotNull(), F.array().cast("array<int>"))
    sums = F.transform(blocks, lambda j: add(F.slice(steps, j * BLOCK + 1, BLOCK)))
    df = df.withColumn(offsets, sums).withColumn(offsets, F.transform(offsets, lambda _, j: add(F.slice(offsets, 1, j))))
    ends = F.flatten(F.transform(offsets, lambda o, j: _bound(F.slice(steps, j * BLOCK + 1, BLOCK), lambda part: F.transform(part, lambda _, i: o + add(F.slice(part, 1, i + 1))))))
    df = df.withColumn(steps, ends)
    near = lambda x, of: F.left(x, F.lit(of))

    def place(g: Column, f: Column, e: Column) -> Column:
        after = lambda i: near(F.get(g, i + 1), NEAR)
        if kind == "iban":  # the heads alone are found: what follows one reaches over others, of four characters each
            reach = REST + NEAR
            after = lambda i: near(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(reach // 4 + 1)), lambda j: F.concat(near(F.coalesce(F.get(g, i + j), F.lit("")), reach), F.coalesce(F.get(f, i + j), F.lit("")))), ""), reach)
        return F.transform(f, lambda m, i: F.struct(m.alias("m"), (F.get(e, i) - F.length(m)).alias("b"), F.right(F.get(g, i), F.lit(NEAR)).alias("l"), after(i).alias("r")))

    placed = _bound(F.col(gaps), lambda g: _bound(F.col(found), lambda f: _bound(F.col(steps), lambda e: place(g, f, e))))
    return df.withColumn(f"__p_{kind}", placed).drop(gaps, found, steps, offsets)


def _ibans() -> Column:
    """The matches of __p_iban, which are the first four characters alone, with all that belongs to them; those where nothing passes are left out.

    ISO 7064 asks for remainder 1 by 97 of the number with the first four
    characters moved to the end, letters as 10 to 35. One walk over what follows
    them keeps the remainder and notes every end of a word at which it fits.
    """
    def whole(x: Column) -> Column:
        head = lambda i: F.ascii(F.substring(x["m"], i, 1)) - 55
        tail = (head(1) * 100 + head(2)) * 100 + F.substring(x["m"], 3, 2).cast("int")
        end = _bound(F.split(F.substring(x["r"], 1, REST + 1), ""), lambda chars: F.aggregate(F.sequence(F.lit(0), F.lit(REST - 1)), F.struct(F.lit(True).alias("alive"), F.lit(0).alias("n"), F.lit(0).alias("rem"), F.lit(0).alias("end")), lambda a, i: _walk(a, chars, i, tail), lambda a: a["end"]))
        return _bound(end, lambda e: F.struct(F.when(e > 0, F.concat(x["m"], x["r"].substr(F.lit(1), e))).alias("m"), x["b"].alias("b"), x["l"].alias("l"), x["r"].substr(e + 1, F.lit(NEAR)).alias("r")))

    found = F.filter(F.transform("__p_iban", whole), lambda x: x["m"].isNotNull())
    # an IBAN that begins inside another one goes
    ends = lambda s, x: F.when(x["b"] < s, s).otherwise(x["b"] + F.length(x["m"]))
    kept = _scan(found, F.lit(0), "array<struct<ok:boolean,x:struct<m:string,b:int,l:string,r:string>>>", ends, lambda s, x: F.struct((x["b"] >= s).alias("ok"), x.alias("x")))
    return F.when(F.col("__p_iban").isNotNull(), F.transform(F.filter(kept, lambda k: k["ok"]), lambda k: k["x"]))


def _walk(a: Column, chars: Column, i: Column, tail: Column) -> Column:
    """The state after the character at i: whether all so far belong together, letters and digits, remainder, last end that fits."""
    ch, after = F.coalesce(F.get(chars, i), F.lit("")), F.coalesce(F.get(chars, i + 1), F.lit(""))
    code = F.ascii(ch)
    digit, letter = code.between(48, 57), code.between(65, 90)
    parted = (ch == " ") & ((i == 0) | (F.coalesce(F.get(chars, i - 1), F.lit("")) != " "))
    own = digit | letter
    alive, n = a["alive"] & (own | parted), a["n"] + own.cast("int")
    rem = F.when(digit, (a["rem"] * 10 + code - 48) % 97).when(letter, (a["rem"] * 100 + code - 55) % 97).otherwise(a["rem"])
    # 10^6 leaves 27
    fits = alive & own & ~after.rlike("[A-Za-z0-9]") & n.between(11, 30) & ((rem * 27 + tail) % 97 == 1)
    return F.when(a["alive"], F.struct(alive.alias("alive"), n.alias("n"), rem.alias("rem"), F.when(fits, i + 1).otherwise(a["end"]).alias("end"))).otherwise(a)


def _scored(kind: str) -> Column:
    """array<struct<kind, b, e, score>> of the valid matches that reach ACCEPT."""
    def score(x: Column) -> Column:
        says = lambda words: F.coalesce(x["l"].rlike(words) | x["r"].rlike(words), F.lit(False))
        moved = F.lit(SCORE[kind]) + F.when(says(CONTEXT[kind]), BOOST).otherwise(0.0) - (F.when(says(SAMPLE), BOOST).otherwise(0.0) if kind in ADDED else F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), x["b"].alias("b"), (x["b"] + F.length(x["m"])).alias("e"), F.round(moved, 2).alias("score"))

    checked = F.transform(F.filter(f"__p_{kind}", lambda x: _valid(kind, x["m"])), score)
    empty = F.array().cast("array<struct<kind:string,b:int,e:int,score:double>>")
    return F.coalesce(F.filter(checked, lambda s: s["score"] >= ACCEPT), empty)


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus __s_<kind>: the accepted spans of each kind in order of their start."""
    df = docs.withColumn("__p_t", F.coalesce(F.col(text), F.lit("")))
    for kind in PATTERNS:
        df = _located(df, kind)
    df = df.withColumn("__p_iban", _ibans())
    df = df.withColumns({f"__s_{k}": _scored(k) for k in PATTERNS})
    return df.drop("__p_t", *[f"__p_{k}" for k in PATTERNS])


def _listed(kinds: tuple[str, ...]) -> Column:
    spans = F.concat(*[F.col(f"__s_{k}") for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["b"].cast("string"), s["e"].cast("string"))), ",")


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, the counts per kind, the digest of the base spans, all spans with their scores and their number; one row per input row."""
    df = with_spans(pick(docs, "doc_id", "text"))
    every = F.concat(*[F.col(f"__s_{k}") for k in PATTERNS])
    return df.select("doc_id", *[F.size(f"__s_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS], F.sha2(F.encode(_listed(BASE), "UTF-8"), 256).alias("base_sha256"), _listed(tuple(PATTERNS)).alias("spans"), F.transform(every, lambda x: x["score"]).alias("scores"), F.size(every).cast("long").alias("n_spans"))


def redact(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The given columns with every span of text replaced by its kind in brackets, and n_chars to match."""
    df = with_spans(pick(docs, *columns))
    every = F.array_sort(F.transform(F.concat(*[F.col(f"__s_{k}") for k in PATTERNS]), lambda s: F.struct(s["b"].alias("b"), s["e"].alias("e"), s["kind"].alias("kind"))))
    df = df.withColumn("__p_all", every)
    # overlapping spans become one, under the kind that begins first: a span that begins at or after all ends so far opens one
    marked = _scan(F.col("__p_all"), F.lit(0), "array<struct<top:int,x:struct<b:int,e:int,kind:string>>>", lambda s, x: F.greatest(s, x["e"]), lambda s, x: F.struct(s.alias("top"), x.alias("x")))
    df = df.withColumn("__p_all", marked)
    opens = F.filter("__p_all", lambda k: k["x"]["b"] >= k["top"])
    df = df.withColumn("__p_cut", F.when(F.size("__p_all") > 0, opens))
    last = F.greatest(F.element_at("__p_all", -1)["top"], F.element_at("__p_all", -1)["x"]["e"])
    # where each ends: the highest end when the next one opens
    t, cut = F.col("text"), F.col("__p_cut")
    df = df.withColumn("__p_cut", F.transform(cut, lambda k, i: F.struct(k["x"]["b"].alias("b"), k["x"]["kind"].alias("kind"), k["top"].alias("from"))))
    # each block is cut out of the text once, its pieces out of the block
    def joined(part: Column) -> Column:
        base = F.element_at(part, 1)["from"]
        return _bound(t.substr(base + 1, F.element_at(part, -1)["b"] - base), lambda seg: F.array_join(F.transform(part, lambda s: F.concat(seg.substr(s["from"] - base + 1, s["b"] - s["from"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))), ""))

    rest = t.substr(last + 1, F.length(t))
    df = df.withColumn("text", F.when(F.col("__p_cut").isNull(), t).otherwise(F.concat(F.array_join(F.transform(_blocks(F.col("__p_cut")), joined), ""), rest)))
    out = {"n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")} if "n_chars" in columns else {}
    return df.withColumns(out).select(*columns) if out else df.select(*columns)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))
