"""Secret scans: base patterns and a randomness test battery (operator 8).

Candidates are long runs of letters and digits of an inferred encoding. Three tests ask how well a candidate fits uniform
randomness over its alphabet: chi-squared, runs about the alphabet's middle, and lag-one serial correlation; Fisher's
method combines them into a score. What is controlled are false discoveries among the reported strings, so the null
hypothesis is a structured string: every text, its candidates left out, is brought into each encoding and laid out in
windows of the least length of each class, all of them, whose scores are the null distribution of that encoding
and length. A p-value is the greater of the share of windows that look as random and the tail of a log-normal
distribution with the windows' moments, so that it is finer than the number of windows. A Benjamini-Hochberg step per
length class, over the candidates of all documents, decides which are reported. Short strings that the tests cannot tell from
structured ones have large p-values and stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A-Z, a-z, 0-9, +, /, _ and - one by one: Java looks them up in a table, but tries ranges one after the other.
LETTER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CANDIDATE = f"(?<![{LETTER}])[{LETTER}]{{16,}}+"
KINDS = ["assign", "access", "hex", "random"]
#: Least length of each class, and the false-discovery rate among its reported candidates.
CLASSES = [(16, 0.05), (20, 0.05), (24, 0.05), (32, 0.05), (48, 0.05), (80, 0.05)]
BINS = 240  # of scores, 20 to a power of ten
#: Matches whose positions are added up together.
CHUNK = 256
#: Characters of a stretch, of which `structured` draws windows in two encodings.
STRETCH = 2000
#: Bits of a letter's place plus 1 in the largest alphabet.
PLANES = 7
#: Windows of the least bin that each null distribution is given beforehand, so that few windows show little; and the least
#: deviation of the logarithms of its bins.
PRIOR, SPREAD = 3, 0.25

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the narrowest: a class of characters, the alphabet in order, and how prose is brought to its case.
ENCODINGS = [
    ("0-9a-f", _DIGITS + "abcdef", F.lower),
    ("0-9A-F", _DIGITS + "ABCDEF", F.upper),
    ("A-Z2-7", _UPPER + "234567", F.upper),
    ("0-9a-z", _DIGITS + _LOWER, F.lower),
    ("0-9A-Z", _DIGITS + _UPPER, F.upper),
    ("1-9A-HJ-NP-Za-km-z", "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", lambda c: c),
    ("0-9A-Za-z", _UPPER + _LOWER + _DIGITS, lambda c: c),
    ("0-9A-Za-z+/_-", _UPPER + _LOWER + _DIGITS + "+/-_", lambda c: c),
]


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _none(kind: str) -> Column:
    return F.from_json(F.lit("[]"), f"array<{kind}>")


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Leftmost non-overlapping matches as an array of (start, order, end, found), in code points.

    Starts are running sums of the lengths of what stands before: the pieces between matches and the matches themselves.
    They are made chunk by chunk, so that time stays near proportion to the matches. keep: of a match, whether it stays.
    """
    order, shape = KINDS.index(kind), "struct<start:int,order:int,end:int,found:string>"
    size = lambda r: F.length(r["gap"]) + F.length(r["found"])

    def placed(chunk: Column, first: Column) -> Column:
        def step(acc: Column, r: Column) -> Column:
            at = acc["at"] + F.length(r["gap"])
            end = at + F.length(r["found"])
            return F.struct(end.alias("at"), F.concat(acc["all"], F.array(F.struct(at.alias("start"), F.lit(order).alias("order"), end.alias("end"), r["found"].alias("found")))).alias("all"))

        return F.aggregate(chunk, F.struct(first.alias("at"), _none(shape).alias("all")), step, lambda acc: acc["all"])

    def of_chunks(chunks: Column) -> Column:
        def step(acc: Column, chunk: Column) -> Column:
            return F.struct((acc["at"] + F.aggregate(chunk, F.lit(0), lambda n, r: n + size(r))).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))

        firsts = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), _none("int").alias("all")), step, lambda acc: acc["all"])
        return F.flatten(F.zip_with(chunks, firsts, placed))

    def all_of(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        rows = F.zip_with(between, found, lambda g, f: F.struct(g.alias("gap"), f.alias("found")))
        chunks = let(rows, lambda r: F.transform(F.sequence(F.lit(1), F.size(r), F.lit(CHUNK)), lambda i: F.slice(r, i, CHUNK)))
        every = let(chunks, of_chunks)
        return F.filter(every, lambda m: keep(m["found"])) if keep else every

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, all_of(found)).otherwise(_none(shape)))


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) by a logistic form, within 0.0002."""
    return 1 / (1 + F.exp(F.greatest(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(300.0)), F.lit(-300.0))))


def _chi2_tail(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root."""
    return _upper_tail((F.pow(x / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))


def encoding(token: Column) -> Column:
    """Index of the narrowest encoding that has all characters of the token."""
    out = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        out = F.when(token.rlike(f"^[{ENCODINGS[i][0]}]+$"), i).otherwise(out)
    return out


def battery(token: Column, kind: Column) -> Column:
    """Fisher's combination of the three tests of one token under uniform randomness over its encoding. Every quantity
    is computed once: an expression inside a lambda would be computed again for each element."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    neighbours = lambda x, f: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), f)

    def codes(alphabet: Column) -> Column:
        x = F.transform(F.split(token, "(?!^)(?!$)"), lambda c: F.call_function("instr", alphabet, c).cast("double") - 1)
        return F.struct(x.alias("x"), F.length(alphabet).cast("double").alias("size"))

    def centred(r: Column) -> Column:
        mean = let(total(r["x"]) / F.size(r["x"]), lambda m: F.transform(r["x"], lambda v: v - m))
        high = let(r["size"] / 2, lambda half: F.transform(r["x"], lambda v: (v >= half).cast("double")))
        # Of sorted codes, 2 i - 1 summed over the places i in each run of equals is the sum of the runs' squares.
        start = F.struct(F.lit(-1.0).alias("code"), F.lit(0.0).alias("i"), F.lit(0.0).alias("sum"))

        def run(acc: Column, v: Column) -> Column:
            i = F.when(v == acc["code"], acc["i"] + 1).otherwise(1.0)
            return F.struct(v.alias("code"), i.alias("i"), (acc["sum"] + 2 * i - 1).alias("sum"))

        return F.struct(r["size"].alias("size"), mean.alias("d"), high.alias("high"), F.aggregate(F.array_sort(r["x"]), start, run, lambda acc: acc["sum"]).alias("squares"))

    def sums(r: Column) -> Column:
        changes = total(neighbours(r["high"], lambda a, b: F.when(a != b, 1.0).otherwise(0.0)))
        variance = F.aggregate(r["d"], F.lit(0.0), lambda s, v: s + v * v)
        lagged = total(neighbours(r["d"], lambda a, b: a * b))
        return F.struct(r["size"].alias("size"), r["squares"].alias("squares"), F.size(r["d"]).cast("double").alias("n"), total(r["high"]).alias("up"), changes.alias("changes"), variance.alias("variance"), lagged.alias("lagged"))

    def tests(r: Column) -> Column:
        n, size = r["n"], r["size"]
        uniform = _chi2_tail(F.greatest(r["squares"] * size / n - n, F.lit(0.0)), size - 1)
        product = 2 * r["up"] * (n - r["up"])
        spread = product * (product - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, 2 * _upper_tail(F.abs((r["changes"] - product / n) / F.sqrt(spread)))).otherwise(1e-6)
        serial = F.when(r["variance"] > 0, 2 * _upper_tail(F.abs(r["lagged"] / r["variance"] * F.sqrt(n)))).otherwise(1e-6)
        part = lambda p: F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12)))
        return _chi2_tail(-2 * (part(uniform) + part(runs) + part(serial)), F.lit(6.0))

    alphabet = F.element_at(F.array(*(F.lit(a) for _, a, _ in ENCODINGS)), kind + 1)
    return let(let(let(let(alphabet, codes), centred), sums), tests)


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, (least, _) in enumerate(CLASSES):
        out = F.when(n >= least, i).otherwise(out)
    return out


def _bin(score: Column) -> Column:
    """0 for what looks most random."""
    return F.least(F.greatest(F.floor(-20 * F.log10(F.greatest(score, F.lit(1e-15)))), F.lit(0)), F.lit(BINS)).cast("int")


def candidates(text: Column) -> Column:
    """Spans of mixed letters and digits, each with its encoding, length class and bin of its score."""
    found = spans(text, CANDIDATE, "random", lambda s: s.rlike("[0-9]") & s.rlike("[A-Za-z]"))
    one = lambda s, kind: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), kind.alias("kind"), length_class(F.length(s["found"])).alias("c"), _bin(battery(s["found"], kind)).alias("bin"))
    return F.transform(found, lambda s: let(encoding(s["found"]), lambda kind: one(s, kind)))


def structured(text: Column) -> Column:
    """A draw of windows of one text, to look at; `scan` takes all windows (`null_counts`). An array of (kind, c, bin). Each stretch gives, in two encodings that its hash picks, one window per length class for which it has enough characters; where in
    the stretch follows the hash, too."""

    def letters(part: Column, kind: Column) -> Column:
        out = F.lit("")
        for i, (chars, _, case) in enumerate(ENCODINGS):
            out = F.when(kind == i, F.regexp_replace(case(part), f"[^{chars}]+", "")).otherwise(out)
        return out

    def windows(part: Column, hash_: Column, kind: Column) -> Column:
        at = lambda own, n: (1 + F.pmod(F.shiftright(hash_, 20), (F.length(own) - n + 1).cast("long"))).cast("int")
        cut = lambda own: F.array(*(F.struct(F.lit(c).alias("c"), F.when(F.length(own) >= n, F.substring(own, at(own, n), F.lit(n))).alias("w")) for c, (n, _) in enumerate(CLASSES)))
        ready = F.filter(let(letters(part, kind), cut), lambda r: r["w"].isNotNull())
        return F.transform(ready, lambda r: F.struct(kind.alias("kind"), r["c"].alias("c"), _bin(battery(r["w"], kind)).alias("bin")))

    def of(part: Column) -> Column:
        half = len(ENCODINGS) // 2
        both = lambda h: F.transform(F.array(*(F.pmod(h + d, F.lit(len(ENCODINGS))).cast("int") for d in (0, half))), lambda kind: windows(part, h, kind))
        return F.flatten(let(F.xxhash64(part), both))

    rest = F.regexp_replace(text, CANDIDATE, "")
    return F.flatten(F.transform(F.regexp_extract_all(rest, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), of))


def _places() -> list[dict[str, int]]:
    """Per encoding, the place in its alphabet of each character that it reads, brought to its case."""
    out = []
    for _, alphabet, _ in ENCODINGS:
        own = {c: i for i, c in enumerate(alphabet)}
        one_case = not (_UPPER[1] in own and _LOWER[1] in own)
        for up, low in zip(_UPPER, _LOWER, strict=True):
            if one_case and (up in own or low in own):
                own[up] = own[low] = own[up] if up in own else own[low]
        out.append(own)
    return out


def _readings() -> dict[int, tuple[list[int], str, str]]:
    """Encoding to (encodings that read every text alike, characters, what `translate` makes of them): the letter's number,
    its place plus 1, in binary-coded decimal, and nothing of the characters that the encoding leaves out."""
    places, out = _places(), {}
    for kind, own in enumerate(places):
        alike = next((k for k in out if places[k] == own), None)
        if alike is None:
            out[kind] = ([kind], "".join([*own, *(c for c in places[-1] if c not in own)]), "".join(chr(int(str(1 + p), 16)) for p in own.values()))
        else:
            out[alike][0].append(kind)
    return out


def _bytes(value: int) -> str:
    """A long with the value in each of its bytes."""
    return f"{value * 0x0101010101010101}L"


def _unfused(name: str) -> str:
    """The column as it is. Spark does not fuse a step that holds a lambda with its neighbours, so that the step's many
    sums become many short methods: one long method would never be compiled to machine code."""
    return f"transform(array({name}), x -> x)[0] AS {name}"


def _rows(docs: DataFrame) -> DataFrame:
    """(kind, size, held, wide, last, n_own, t0..t11): of every text in each encoding, without candidates, its letters in rows
    of 96 (wide) and again in rows of 80, as numbers from 1, one per byte, the first in the highest; 0 is no letter. A row of 96 is 12
    blocks of 8; one of 80 is 4 times 20, each in blocks of 8, 8 and 4. The last row of either kind (last) ends with the text, and
    is filled up from the left. size: letters of the alphabet; held: of the text; n_own: of the row."""
    clean = docs.select(F.regexp_replace(F.coalesce("text", F.lit("")), f"{CANDIDATE}|[^{LETTER}]+", "").alias("clean"))
    each = [F.struct(F.lit(k).alias("kind"), F.lit(len(ENCODINGS[k][1])).alias("size"), F.translate("clean", old, new).alias("own")) for k, (_, old, new) in _readings().items()]
    own = clean.select(F.explode(F.array(*each)).alias("s")).select("s.*", F.length("s.own").alias("held")).filter(F.col("held") >= CLASSES[0][0])
    cut = lambda n: F.concat(F.regexp_extract_all("own", F.lit(f"(?s).{{1,{n}}}"), F.lit(0)), F.array(F.lpad(F.right("own", F.lit(n)), n, "\0")))
    r = own.select("kind", "size", "held", F.explode(F.array(F.struct(F.lit(True).alias("wide"), cut(96).alias("all")), F.struct(F.lit(False).alias("wide"), cut(80).alias("all")))).alias("r"))
    r = r.select("kind", "size", "held", "r.wide", (F.size("r.all") - 1).alias("rows"), F.posexplode_outer("r.all").alias("i", "s"))
    r = r.select("kind", "size", "held", "wide", F.coalesce(F.col("i") == F.col("rows"), F.lit(True)).alias("last"), F.length("s").alias("n_own"), F.rpad("s", 104, "\0").cast("binary").alias("s")).filter("n_own >= if(wide, 16, 20)")
    meta = ["kind", "size", "held", "wide", "last"]
    # The hexadecimal digits of binary-coded decimals are decimal: 8 letters are 8 pairs of digits of a number.
    r = r.selectExpr(*meta, "n_own", *(f"cast(hex(substring(s, if(wide, {8 * j + 1}, {20 * (j // 3) + 8 * (j % 3) + 1}), 8)) AS long) AS t{j}" for j in range(12)))
    # Split in halves, twice; then each two bytes hold a pair of letters, which a multiplication divides by 100 everywhere at once.
    halves = lambda t: f"(({t} div 10000) << 16) | ({t} % 10000)"
    r = r.selectExpr(*meta, _unfused("n_own"), *(f"coalesce((({halves(f't{j} div 100000000')}) << 32) | {halves(f'(t{j} % 100000000)')}, 0L) AS t{j}" for j in range(12)))
    low, part = 0x0000FFFF0000FFFF, 0x000000FF000000FF
    r = r.selectExpr(*meta, "n_own", *(f"t{j}" for j in range(12)), *(f"((((t{j} & {low}L) * 5243L) >>> 19) & {part}L) | ((((((t{j} >>> 16) & {low}L) * 5243L) >>> 19) & {part}L) << 16) AS q{j}" for j in range(12)))
    kept = lambda j: f" & if(wide, -1L, {-1 << 32}L)" if j % 3 == 2 else ""
    return r.selectExpr(*meta, "n_own", *(f"((q{j} << 8) | (t{j} - q{j} * 100L)){kept(j)} AS t{j}" for j in range(12)))


#: Windows in rows of 96 and of 80: (length, first block, blocks).
_WIDE = [(n, k * n // 8, n // 8) for n in (16, 24, 32, 48) for k in range(96 // n)]
_NARROW = [(20, 3 * k, 3) for k in range(4)] + [(80, 0, 12)]
#: What the sum of squares of a window's numbers and the sum of the products of neighbours are multiplied with to stand in one
#: double with their sum, and what changes between halves of the alphabet, the first and last number, the sum of squared counts
#: and the length class are multiplied with to stand in one with how many letters are in the upper half.
_S2, _LAG = 2**13, 2**32
_CHANGES, _ENDS, _SQUARES, _CLASS = 2**7, 2**14, 2**22, 2**35


def _blocks(rows: DataFrame) -> DataFrame:
    """Of each block the counts of its letters as bit planes k{j}_0..k{j}_3, letter 1 in the lowest bit: k{j}_0 is 1 where a letter is found
    an odd number of times, and so on. Letters from 64 on are left out. u{j}: the bits 6 of the bytes of letters in the
    upper half; s{j}: sums as of `_S2`."""
    odd = lambda *x: " ^ ".join(x)
    two = lambda x, y, z: f"(({x} & {y}) | ({z} & ({x} | {y})))"  # noqa: E731  # at least two of three
    hot = lambda j, k: f"((((t{j} >>> {62 - 8 * k}) & 1L) ^ 1L) << int((t{j} >>> {56 - 8 * k}) & 63L)) >>> 1"
    sums = lambda j: " + ".join(f"x{j}_{k} * (1D + {_S2}D * x{j}_{k}{f' + {_LAG}D * x{j}_{k + 1}' if k < 7 else ''})" for k in range(8))
    has = ["kind", "size", "held", "wide", "last", *(f"t{j}" for j in range(12))]
    step = rows.select("*", F.expr(f"CASE size {' '.join(f'WHEN {n} THEN {_bytes(63 - n // 2)}' for n in sorted({len(a) for _, a, _ in ENCODINGS}))} ELSE 0L END").alias("h"))
    for part in (range(a, a + 2) for a in range(0, 12, 2)):
        each = lambda f, own=part: [f(j) for j in own]
        letters = lambda f, own=part: [f(j, k) for j in own for k in range(8)]
        step = step.selectExpr(*has, "h", _unfused("n_own"))
        step = step.selectExpr(*has, "h", "n_own", *letters(lambda j, k: f"double((t{j} >>> {56 - 8 * k}) & 127L) AS x{j}_{k}"))
        step = step.selectExpr(*has, "h", "n_own", *each(lambda j: f"{sums(j)} AS s{j}"), *each(lambda j: f"(t{j} + h) & {_bytes(64)} AS u{j}"))
        has += each(lambda j: f"s{j}") + each(lambda j: f"u{j}")
        step = step.selectExpr(*has, "h", "n_own", *letters(lambda j, k: f"{hot(j, k)} AS x{j}_{k}"))
        # Eight bits are added up: three and three, what is left of them and the seventh, and the eighth.
        x = lambda j, *own: [f"x{j}_{k}" for k in own]
        step = step.selectExpr(*has, "h", "n_own", *(y for j in part for y in (f"{odd(*x(j, 0, 1, 2))} AS a{j}", f"{two(*x(j, 0, 1, 2))} AS b{j}", f"{odd(*x(j, 3, 4, 5))} AS c{j}", f"{two(*x(j, 3, 4, 5))} AS d{j}", *x(j, 6, 7))))
        step = step.selectExpr(*has, "h", "n_own", *(y for j in part for y in (f"a{j} ^ c{j} ^ x{j}_6 AS a{j}", f"{two(f'a{j}', f'c{j}', f'x{j}_6')} AS c{j}", f"b{j}", f"d{j}", f"x{j}_7")))
        step = step.selectExpr(*has, "h", "n_own", *(y for j in part for y in (f"a{j} ^ x{j}_7 AS k{j}_0", f"a{j} & x{j}_7 AS a{j}", f"b{j} ^ c{j} ^ d{j} AS b{j}", f"{two(f'b{j}', f'c{j}', f'd{j}')} AS c{j}")))
        step = step.selectExpr(*has, "h", "n_own", *(y for j in part for y in (f"k{j}_0", f"a{j} ^ b{j} AS k{j}_1", f"a{j} & b{j} AS a{j}", f"c{j}")))
        step = step.selectExpr(*has, "h", "n_own", *(y for j in part for y in (f"k{j}_0", f"k{j}_1", f"a{j} ^ c{j} AS k{j}_2", f"a{j} & c{j} AS k{j}_3")))
        has += [f"k{j}_{i}" for j in part for i in range(4)]
    return step


def _sums(blocks: DataFrame) -> DataFrame:
    """Of each window of a row two of its sums, in arrays: see `_S2`. others: squared counts of the letters from 64 on, if a row has any."""
    own = range(12)
    planes = [f"k{j}_{i}" for j in own for i in range(4)]
    meta = ["kind", "size", "held", "wide", "last"]
    # The third block of a narrow row's windows ends with its fourth letter.
    laid_out = lambda j, wide, narrow: f"if(wide, {wide}, {narrow})" if j % 3 == 2 else wide
    end = lambda j: f"double({laid_out(j, f't{j} & 127L', f'(t{j} >>> 32) & 127L')})"
    upper_end = lambda j: laid_out(j, f"u{j} & 64L", f"(u{j} >>> 32) & 64L")
    inner = lambda j: f"(u{j} ^ (u{j} << 8)) & {laid_out(j, f'{0x4040404040404000}L', f'{0x4040400000000000}L')}"
    step = blocks.selectExpr(
        *meta, _unfused("n_own"), *planes, *(f"t{j}" for j in own), *(f"s{j}" for j in own),
        *(f"double(bit_count(u{j})) + {_CHANGES}D * double(bit_count({inner(j)})) AS u{j}" for j in own),
        *(f"{_LAG}D * {end(j)} * double(t{j + 1} >>> 56) AS v{j}" for j in own[:-1]), *(f"if(({upper_end(j)}) = (u{j + 1} >>> 56), 0D, {_CHANGES}D) AS w{j}" for j in own[:-1]),
        *(f"{_ENDS}D * double(t{j} >>> 56) AS x{j}" for j in own), *(f"{_ENDS}D * {end(j)} AS y{j}" for j in own),
    )

    def others(at: int, n: int) -> str:
        """In their bytes bit 6 is set, and bits 0 and 1 tell them apart."""
        masks = {64: "t{0} & ~(t{0} << 6) & ~(t{0} << 5)", 65: "t{0} & (t{0} << 6)", 66: "t{0} & (t{0} << 5)"}
        count = lambda m: "(" + " + ".join(f"double(bit_count({m.format(j)} & {_bytes(64)}))" for j in range(at, at + n)) + ")"
        return " + ".join(f"{count(m)} * {count(m)}" for m in masks.values())

    def window(n: int, at: int, k: int) -> tuple[str, str, str]:
        inside, between = range(at, at + k), range(at, at + k - 1)
        c = [least for least, _ in CLASSES].index(n)
        sums = [*(f"s{j}" for j in inside), *(f"v{j}" for j in between)]
        rest = [*(f"u{j}" for j in inside), *(f"w{j}" for j in between), f"x{at}", f"y{at + k - 1}", f"{c * _CLASS}D"]
        return " + ".join(sums), " + ".join(rest), others(at, k)

    windows = [[window(*w) for w in layout] for layout in (_WIDE, _NARROW)]
    array = lambda i: "if(wide, " + ", ".join(f"array({', '.join(w[i] for w in layout)})" for layout in windows) + ")"
    return step.selectExpr(*meta, _unfused("n_own"), *planes, f"{array(0)} AS sums", f"{array(1)} AS rest", f"if((({' | '.join(f't{j}' for j in own)}) & {_bytes(64)}) != 0, {array(2)}, null) AS others")


def _plus(x: list[str], y: list[str], name: str) -> list[str]:
    """The planes of the sum of two counts: addition with carry, for 64 letters at once."""
    out, carry = [], None
    for i, a in enumerate(x):
        b = y[i] if i < len(y) else "0L"
        own = [a] + ([b] if i < len(y) else []) + ([carry] if carry else [])
        out.append(f"({' ^ '.join(own)}) AS {name}{i}")
        carry = f"(({a} & {b}) | ({carry} & ({a} ^ {b})))" if carry and i < len(y) else f"({' & '.join(own)})"
    return [*out, f"{carry} AS {name}{len(x)}"]


def _windows(docs: DataFrame) -> DataFrame:
    """All windows of the least length of each class, end to end, the last moved back so that it ends with the text:
    (kind, size, sums, rest), both as of `_S2`."""
    step = _sums(_blocks(_rows(docs)))
    meta = ["kind", "size", "held", "wide", "last", "n_own", "sums", "rest", "others"]
    planes = lambda name, n: [f"{name}{i}" for i in range(n)]
    count = lambda x: f"double(bit_count({x}))"
    # Of counts in planes the sum of their squares.
    squares = lambda x, name: " + ".join([*(f"{4**i}D * {count(p)}" for i, p in enumerate(x)), *(f"{2 ** (i + j + 1)}D * {count(f'{p} & {q}')}" for i, p in enumerate(x) for j, q in enumerate(x[:i]))]) + f" AS {name}"
    wide = lambda x: f"if(wide, {x.rsplit(' AS ', 1)[0]}, 0D) AS {x.rsplit(' AS ', 1)[1]}"
    block = lambda j: planes(f"k{j}_", 4)
    pairs = [0, 2, 3, 4, 6, 8, 9, 10]
    step = step.selectExpr(*meta, *(x for j in pairs for x in _plus(block(j), block(j + 1), f"p{j}_")), *(x for j in (2, 5, 8, 11) for x in block(j)))
    pair = lambda j: planes(f"p{j}_", 5)
    step = step.selectExpr(
        *meta[:5], _unfused("n_own"), *meta[6:], *(x for j in (0, 3, 6, 9) for x in _plus(pair(j), block(j + 2), f"h{j}_")[:5]), *(x for j in (0, 4, 8) for x in _plus(pair(j), pair(j + 2), f"q{j}_")),
        *(wide(squares(pair(j), f"w16_{j}")) for j in range(0, 12, 2)),
    )
    three, four = lambda j: planes(f"h{j}_", 5), lambda j: planes(f"q{j}_", 6)
    step = step.selectExpr(
        *meta[:5], _unfused("n_own"), *meta[6:], *(x for j in (0, 6) for x in _plus(three(j), three(j + 3), f"s{j}_")), *(f"w16_{j}" for j in range(0, 12, 2)),
        *(squares(three(j), f"w24_{j}") for j in (0, 3, 6, 9)), *(wide(squares(four(j), f"w32_{j}")) for j in (0, 4, 8)),
    )
    six = lambda j: planes(f"s{j}_", 6)
    done = [f"w16_{j}" for j in range(0, 12, 2)] + [f"w24_{j}" for j in (0, 3, 6, 9)] + [f"w32_{j}" for j in (0, 4, 8)]
    step = step.selectExpr(*meta, *done, *_plus(six(0), six(6), "e"), *(wide(squares(six(j), f"w48_{j}")) for j in (0, 6)))
    # A window counts if it ends with or before its row's letters; in a text's last rows, if it ends with the text and does not stand elsewhere.
    stays = lambda own, full: [f"if(last, {at + k == 12} AND {n} <= held AND held % {n} > 0, {at * full // 12 + n} <= n_own)" for n, at, k in own]
    array = lambda values, own, full: f"array({', '.join(f'if({s}, {v} + coalesce(get(others, {i}), 0D), -1D)' for i, (s, v) in enumerate(zip(stays(own, full), values, strict=True)))})"
    squares_80 = squares(planes("e", 7), "x").rsplit(" AS ", 1)[0]
    step = step.selectExpr(_unfused("kind"), "size", "sums", "rest", f"if(wide, {array([*done, 'w48_0', 'w48_6'], _WIDE, 96)}, {array([*(f'w24_{j}' for j in (0, 3, 6, 9)), squares_80], _NARROW, 80)}) AS squares")
    step = step.selectExpr("kind", "size", "sums", "rest", "posexplode_outer(squares) AS (i, squares)").filter("squares >= 0D")
    return step.selectExpr("kind", "size", "get(sums, i) AS sums", f"bigint(get(rest, i) + {_SQUARES}D * squares) AS rest")


def _part(p: Column) -> Column:
    return F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12)))


def null_counts(docs: DataFrame) -> DataFrame:
    """(kind, c, bin, k): how many windows of all texts score so, each as in `battery`. Two of the three tests depend on few
    numbers only, and are looked up."""
    col = F.col
    tail = lambda z: F.when(z.isNull(), 1e-6).otherwise(2 * _upper_tail(F.abs(z)))
    one = docs.sparkSession.range(1)
    classes = F.array(*(F.struct(F.lit(c).cast("long").alias("c"), F.lit(float(n)).alias("n"), F.lit(n).cast("long").alias("m")) for c, (n, _) in enumerate(CLASSES)))
    sizes = F.array(*(F.lit(float(s)) for s in sorted({len(a) for _, a, _ in ENCODINGS})))
    own = one.select(F.inline(classes))
    uniform = own.select("*", F.explode(sizes).alias("size")).select("c", "n", "size", F.explode(F.expr("sequence(m, m * m, 2)")).alias("squares"))
    fit = _chi2_tail(F.greatest(col("squares").cast("double") * col("size") / col("n") - col("n"), F.lit(0.0)), col("size") - 1)
    uniform = uniform.select((col("squares") + col("c") * (_CLASS // _SQUARES) + col("size").cast("long") * (8 * _CLASS // _SQUARES)).alias("of_squares"), _part(fit).alias("uniform"))
    runs = own.select("*", F.explode(F.expr("sequence(0L, m)")).alias("up")).select("c", "n", "up", F.explode(F.expr("sequence(0L, m - 1)")).alias("changes"))
    runs = runs.select("c", "n", "up", "changes", (2 * col("up").cast("double") * (col("n") - col("up"))).alias("product"))
    spread = col("product") * (col("product") - col("n")) / (col("n") * col("n") * (col("n") - 1))
    z = F.when(spread > 0, (col("changes").cast("double") - col("product") / col("n")) / F.sqrt(spread))
    runs = runs.select((col("up") + col("changes") * _CHANGES + col("c") * _ENDS).alias("of_runs"), _part(tail(z)).alias("runs"))

    w = _windows(docs).selectExpr(
        "kind", "int(rest >>> 35) AS c", "(rest >>> 22) | (bigint(size) << 16) AS of_squares", f"(rest & {_ENDS - 1}L) | ((rest >>> 35) << 14) AS of_runs", "double((rest >>> 14) & 255L) AS ends",
        f"double(floor(sums / {_LAG}D)) AS lag", "sums",
    )
    w = w.join(F.broadcast(uniform), "of_squares").join(F.broadcast(runs), "of_runs")
    w = w.selectExpr("kind", "c", f"double({'element_at(array(' + ', '.join(str(n) for n, _ in CLASSES) + '), c + 1)'}) AS n", "ends", "lag", "uniform", "runs", f"sums - {_LAG}D * lag AS sums")
    w = w.selectExpr("*", f"double(floor(sums / {_S2}D)) AS s2").selectExpr("*", f"sums - {_S2}D * s2 AS s1")
    w = w.select("*", ((col("n") * col("s2") - col("s1") * col("s1")) / col("n")).alias("variance"), (col("s1") / col("n")).alias("mean"))
    lagged = col("lag") - col("mean") * (2 * col("s1") - col("ends")) + (col("n") - 1) * col("mean") * col("mean")
    w = w.select("kind", "c", "uniform", "runs", F.when(col("variance") > 0, lagged / col("variance") * F.sqrt("n")).alias("serial"))
    w = w.select("kind", "c", _bin(_chi2_tail(-2 * (col("uniform") + col("runs") + _part(tail(col("serial")))), F.lit(6.0))).alias("bin"))
    counts = w.groupBy("kind", "c", "bin").agg(F.count(F.lit(1)).alias("k"))
    kinds = F.create_map(*(x for k, (alike, _, _) in _readings().items() for x in (F.lit(k), F.array(*map(F.lit, alike)))))
    return counts.select(F.explode(F.element_at(kinds, col("kind"))).alias("kind"), "c", "bin", "k")


def thresholds(scored: DataFrame, null: DataFrame | None = None) -> dict[tuple[int, int], int]:
    """Per encoding and length class, the greatest bin that is reported. From histograms of encodings x classes x bins.
    null: (kind, c, bin, k) as of `null_counts`; without it, the windows in the column null of scored."""
    if null is None:
        null = scored.select(F.explode("null").alias("s")).groupBy("s.kind", "s.c", "s.bin").agg(F.count(F.lit(1)).alias("k"))
    null = null.withColumn("m", F.lit(0).cast("long"))
    found = scored.select(F.explode("r").alias("s")).groupBy("s.kind", "s.c", "s.bin").agg(F.lit(0).cast("long").alias("k"), F.count(F.lit(1)).alias("m"))
    cell = Window.partitionBy("kind", "c")
    counts = stage(null.unionByName(found).groupBy("kind", "c", "bin").agg(F.sum("k").alias("k"), F.sum("m").alias("m")), "scores")
    n = F.sum("k").over(cell) + PRIOR
    y = F.log1p("bin")
    mean = F.sum(F.col("k") * y).over(cell) / n
    spread = F.greatest(F.sqrt(F.greatest(F.sum(F.col("k") * y * y).over(cell) / n - mean * mean, F.lit(0.0))), F.lit(SPREAD))
    p = counts.select("kind", "c", "bin", "m", F.greatest(F.sum("k").over(cell.orderBy("bin")) / n, _upper_tail((mean - y) / spread)).alias("p"))
    by_class = Window.partitionBy("c")
    rate = F.element_at(F.array(*(F.lit(q) for _, q in CLASSES)), F.col("c") + 1)
    ranked = p.filter("m > 0").select("*", F.sum("m").over(by_class.orderBy("p")).alias("upto"), F.sum("m").over(by_class).alias("all"))
    cut = F.max(F.when(F.col("p") <= F.col("upto") * rate / F.col("all"), F.col("p"))).over(by_class)
    passed = ranked.withColumn("cut", cut).filter(F.col("p") <= F.col("cut")).groupBy("kind", "c").agg(F.max("bin").alias("bin"))
    return {(r.kind, r.c): r.bin for r in passed.collect()}


def _join(all_spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    base_sha256 is of the base spans kind:start:end by start, then kind, comma-joined; spans also has the battery's
    finds that overlap no base span. A null text counts as empty: no spans. Repeated rows and null ids are kept; other
    columns are not read. Matches are found in whole texts, which are read twice: for spans and for the null distributions. With very few texts the null
    distributions have few windows, so that p-values are large and little or nothing is reported beyond the base spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end")))
    value = lambda found: F.length(F.regexp_extract(found, ASSIGN, 2)) >= 8
    scored = docs.select(
        "doc_id", bare(spans(text, ASSIGN, "assign", value)).alias("a"), bare(spans(text, ACCESS, "access")).alias("k"), bare(spans(text, HEX, "hex")).alias("h"), candidates(text).alias("r")
    )
    scored = stage(scored, "scored")
    greatest = thresholds(scored, null_counts(docs))

    def is_random(s: Column) -> Column:
        bound = F.lit(-1)
        for (kind, c), v in greatest.items():
            bound = F.when((s["kind"] == kind) & (s["c"] == c), F.lit(v)).otherwise(bound)
        return s["bin"] <= bound

    base = scored.select("doc_id", F.size("a").cast("long").alias("n_assign"), F.size("k").cast("long").alias("n_access"), F.size("h").cast("long").alias("n_hex"), F.array_sort(F.concat("a", "k", "h")).alias("base"), "r")
    extra = bare(F.filter("r", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & is_random(s)))
    out = base.withColumn("extra", extra)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_join(F.col("base")), 256).alias("base_sha256"), _join(F.array_sort(F.concat("base", "extra"))).alias("spans"), F.size("extra").cast("long").alias("n_random"))
