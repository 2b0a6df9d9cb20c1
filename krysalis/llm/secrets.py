"""Secret scans in DataFrame functions: fixed forms and a randomness test battery."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from krysalis.llm.common import text_of

#: The base forms as (kind, pattern, group whose length counts, least length).
FORMS = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # a maximal run, as of [0-9a-f]+
)
#: What the battery looks at: unbroken strings over the alphabets of the usual encodings.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Encodings by pattern with their alphabet, in the order they are tried.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Encodings that natural strings are made in: words run together, run together in capitals, with a capital each, joined by a sign.
FORMED = ("lower", "base32", "alnum", "base64")
#: Letters of English prose as often as among a hundred.
LETTERS = "e" * 13 + "t" * 9 + "a" * 8 + "o" * 8 + "i" * 7 + "n" * 7 + "s" * 6 + "h" * 6 + "r" * 6 + "d" * 4 + "l" * 4 + "u" * 3 + "c" * 3 + "m" * 3 + "w" * 2 + "f" * 2 + "g" * 2 + "y" * 2 + "p" * 2 + "bvk"
#: Sequences of words drawn from them that stand beside those of the table, so that tables of few or short texts have natural strings too.
DRAWN = 2000
#: Encodings without natural strings of their own are held against those of another; decimal strings are no secrets.
NULL_OF = {"hex": "base32", "HEX": "base32"} | {e: e for e in FORMED}
#: Lengths from which a stratum of the false-discovery control begins.
STRATA = (20, 28, 40, 64)
#: False discoveries allowed among the spans that the battery adds.
FDR = 0.01
#: The battery's p-values are counted in bins of a twentieth of a decade, down to 1e-10.
BINS, PER_DECADE = 201, 20
#: Positions are summed in blocks of so many matches.
BLOCK = 128
#: Natural strings are cut from blocks of so many characters, a multiple of all lengths that begin a stratum.
CUT = 2240

_SPAN = "struct<start:int,end:int,kind:string>"
_WORD = "struct<start:int,end:int,kind:string,word:string>"


def _scan(items: str, start: str, out: str, step: str, emit: str) -> str:
    """SQL: for each element x of ``items`` in order ``emit``, given the state c.s, which begins as ``start`` and goes on as ``step``.

    An aggregate copies its array at every step; in blocks, the copies stay
    small, so that very many matches take time nearly in proportion.
    """
    empty = f"CAST(array() AS array<{out}>)"
    inner = f"aggregate(block, named_struct('s', a.s, 'out', {empty}), (c, x) -> named_struct('s', {step}, 'out', concat(c.out, array({emit}))))"
    outer = f"transform(array({inner}), r -> named_struct('s', r.s, 'out', concat(a.out, array(r.out))))[0]"
    blocks = f"transform(sequence(0, (size(t) - 1) DIV {BLOCK}), i -> slice(t, CAST(i * {BLOCK} + 1 AS INT), {BLOCK}))"
    run = f"aggregate({blocks}, named_struct('s', {start}, 'out', CAST(array() AS array<array<{out}>>)), (a, block) -> {outer}, a -> flatten(a.out))"
    return f"transform(array({items}), t -> IF(size(t) = 0, {empty}, {run}))[0]"


def _located(text: str, pattern: str, group: int, at_least: int, kind: str) -> Column:
    """Spans and words of all matches, leftmost first and without overlap, whose ``group`` has ``at_least`` characters.

    SQL gives the matches and the gaps between them; running sums of their
    lengths are the positions.
    """
    quoted = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    part = f"regexp_extract(x.f, {quoted}, {group})" if group else "x.f"
    matches = f"filter(zip_with(split({text}, {quoted}, -1), regexp_extract_all({text}, {quoted}, 0), (g, f) -> named_struct('g', length(g), 'f', f)), x -> x.f IS NOT NULL)"
    step = "c.s + x.g + length(x.f)"
    emit = f"named_struct('start', c.s + x.g, 'end', {step}, 'kind', IF(length({part}) >= {at_least}, '{kind}', ''), 'word', x.f)"
    found = f"filter({_scan(matches, '0', _WORD, step, emit)}, x -> x.kind <> '')"
    return F.expr(f"CASE WHEN {text} RLIKE {quoted} THEN {found} ELSE CAST(array() AS array<{_WORD}>) END")


def _upper_tail(z: str) -> str:
    """SQL: P(Z > z) of a standard normal by the logistic approximation, within 2e-4 near zero and of the right order in the tail used."""
    return f"(1D / (1D + exp(least(600D, greatest(-600D, 1.5976D * ({z}) + 0.07056D * power({z}, 3))))))"


def battery_sql(string: str) -> str:
    """SQL of the test battery on one string: ``encoding, chi_p, runs_p, serial_p, random_p, bin``.

    The encoding is inferred from the characters. Under "random" its codes are
    uniform and independent: chi-squared over the alphabet (Wilson-Hilferty
    tail); the runs test, about the alphabet's middle where it has one class of
    characters, otherwise on the changes between digits, upper case, lower case
    and signs; the lag-one serial correlation. ``random_p`` is their combination
    by Fisher's method, ``bin`` its place on a logarithmic scale, 0 for the most
    random. The padding ``=`` is left out.
    """
    name = "CASE " + " ".join(f"WHEN {string} RLIKE '{p}' THEN '{n}'" for n, p, _ in ENCODINGS[:-1]) + f" ELSE '{ENCODINGS[-1][0]}' END"
    of = lambda values: "CASE s.e " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in values) + " END"
    shares = {n: [sum(map(t, a)) / len(a) for t in (str.isdigit, str.isupper, str.islower, lambda c: not c.isalnum())] for n, _, a in ENCODINGS}
    two = {n: 0.5 if max(p) == 1 else sum(v**2 for v in p) for n, p in shares.items()}
    three = {n: 0.25 if max(p) == 1 else sum(v**3 for v in p) for n, p in shares.items()}
    classes = {n: "IF(s.p[i] >= s.k / 2, 1, 0)" if max(p) == 1 else "CASE WHEN s.c[i] BETWEEN '0' AND '9' THEN 0 WHEN s.c[i] BETWEEN 'A' AND 'Z' THEN 1 WHEN s.c[i] BETWEEN 'a' AND 'z' THEN 2 ELSE 3 END" for n, p in shares.items()}
    middle = ", ".join(f"'{n}'" for n, p in shares.items() if max(p) == 1)
    by_class = next(v for n, v in classes.items() if n == "base64")
    by_middle = next(v for n, v in classes.items() if n == "lower")
    steps = [  # each step reads the struct s of those before
        ("e", name),
        ("a", of((n, f"'{a}'") for n, _, a in ENCODINGS)),
        ("c", f"filter(split({string}, ''), x -> x <> '' AND x <> '=')"),
        ("n", "CAST(size(s.c) AS DOUBLE)"),
        ("k", "CAST(length(s.a) AS DOUBLE)"),
        ("p", "transform(s.c, x -> CAST(instr(s.a, x) - 1 AS DOUBLE))"),
        ("m", "aggregate(s.p, 0D, (t, x) -> t + x) / s.n"),
        ("sq", "aggregate(sequence(0, CAST(s.k AS INT) - 1), 0D, (t, i) -> t + power(s.n - size(array_remove(s.p, CAST(i AS DOUBLE))), 2))"),
        ("ss", "greatest(1e-9D, aggregate(s.p, 0D, (t, x) -> t + power(x - s.m, 2)))"),
        ("lag", "aggregate(sequence(1, size(s.p) - 1), 0D, (t, i) -> t + (s.p[i] - s.m) * (s.p[i - 1] - s.m))"),
        ("g", f"IF(s.e IN ({middle}), transform(s.c, (x, i) -> {by_middle}), transform(s.c, (x, i) -> {by_class}))"),
        ("chg", "CAST(size(filter(sequence(1, size(s.g) - 1), i -> s.g[i] <> s.g[i - 1])) AS DOUBLE)"),
        ("q", "1D - " + of((n, f"{v!r}D") for n, v in two.items())),
        ("both", "2D * s.q - 1D + " + of((n, f"{v!r}D") for n, v in three.items())),
        ("chi", "s.sq * s.k / s.n - s.n"),
        ("chi_p", _upper_tail("(power(greatest(s.chi, 0D) / (s.k - 1), 1D/3) - (1 - 2/(9*(s.k - 1)))) / sqrt(2/(9*(s.k - 1)))")),
        ("vr", "(s.n - 1) * s.q * (1 - s.q) + 2 * (s.n - 2) * (s.both - s.q * s.q)"),
        ("runs_p", "least(1D, 2 * " + _upper_tail("abs(s.chg - (s.n - 1) * s.q) / sqrt(greatest(1e-9D, s.vr))") + ")"),
        ("serial_p", "least(1D, 2 * " + _upper_tail("abs(s.lag / s.ss + 1 / s.n) * sqrt(s.n)") + ")"),
        ("f", "-ln(greatest(1e-300D, s.chi_p)) - ln(greatest(1e-300D, s.runs_p)) - ln(greatest(1e-300D, s.serial_p))"),
        ("random_p", "exp(-least(s.f, 600D)) * (1 + s.f + s.f * s.f / 2)"),
        ("bin", f"CAST(least({BINS - 1}D, greatest(0D, floor(-{PER_DECADE}D * log10(s.random_p)))) AS INT)"),
    ]
    # Each value is bound once as the only element of an array: transform() is SQL's let.
    body = "named_struct('encoding', s.e, 'chi_p', s.chi_p, 'runs_p', s.runs_p, 'serial_p', s.serial_p, 'random_p', s.random_p, 'bin', s.bin)"
    known: list[str] = []
    expr = "array(named_struct('nothing', 0))"
    for field, value in steps:
        fields = ", ".join(f"'{k}', s.{k}" for k in known) + (", " if known else "")
        expr = f"transform({expr}, s -> named_struct({fields}'{field}', {value}))"
        known.append(field)
    return f"transform({expr}, s -> {body})[0]"


def _counts(words: DataFrame) -> dict:
    """How often each (stratum, encoding, bin) occurs; bounded whatever the table holds."""
    stratum = sum((F.when(F.col("n") >= lo, 1).otherwise(0) for lo in STRATA), F.lit(-1)).alias("s")
    tested = words.select(stratum, F.expr(battery_sql("word")).alias("t")).select("s", "t.encoding", "t.bin")
    return {(r["s"], r["encoding"], r["bin"]): r["count"] for r in tested.groupBy("s", "encoding", "bin").count().collect()}


def battery_bins(strings: np.ndarray, encoding: str) -> np.ndarray:
    """The ``bin`` of ``battery_sql`` for the rows of a matrix of characters, all of one encoding and length: the plain version that ``natural_counts`` is tested against."""
    alphabet = dict((e, a) for e, _, a in ENCODINGS)[encoding]
    code = np.zeros(256, np.int64)
    code[np.frombuffer(alphabet.encode(), np.uint8)] = np.arange(len(alphabet))
    kinds = np.array([0 if chr(c).isdigit() else 1 if chr(c).isupper() else 2 if chr(c).islower() else 3 for c in range(128)] + [3] * 128, np.int8)
    shares = np.array([sum(kinds[ord(c)] == t for c in alphabet) / len(alphabet) for t in range(4)])
    rows, n, k, middle = len(strings), strings.shape[1], len(alphabet), shares.max() == 1
    at = code[strings]
    times = np.bincount((at + np.arange(rows)[:, None] * k).ravel(), minlength=rows * k).reshape(rows, k)
    p = at - at.mean(1, keepdims=True)
    squares, ss, lag = (times * times).sum(1), np.maximum(1e-9, (p * p).sum(1)), (p[:, 1:] * p[:, :-1]).sum(1)
    group = at >= k / 2 if middle else kinds[strings]
    changes = (group[:, 1:] != group[:, :-1]).sum(1)
    q = 1 - (0.5 if middle else (shares**2).sum())
    both = 2 * q - 1 + (0.25 if middle else (shares**3).sum())
    tail = lambda z: 1 / (1 + np.exp(np.clip(1.5976 * z + 0.07056 * z**3, -600, 600)))
    chi_p = tail((np.cbrt(np.maximum(squares * k / n - n, 0) / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / np.sqrt(2 / (9 * (k - 1))))
    spread = np.sqrt(max(1e-9, (n - 1) * q * (1 - q) + 2 * (n - 2) * (both - q * q)))
    runs_p = np.minimum(1, 2 * tail(np.abs(changes - (n - 1) * q) / spread))
    serial_p = np.minimum(1, 2 * tail(np.abs(lag / ss + 1 / n) * np.sqrt(n)))
    f = -sum(np.log(np.maximum(1e-300, x)) for x in (chi_p, runs_p, serial_p))
    random_p = np.exp(-np.minimum(f, 600)) * (1 + f + f * f / 2)
    return np.clip(np.floor(-PER_DECADE * np.log10(random_p)), 0, BINS - 1).astype(np.int64)


def natural_strings(texts: list[str], signs: list[bool], encoding: str, n: int, at_once: int = 1 << 14) -> Iterator[np.ndarray]:
    """All words of each text, in small letters and parted by a space, as strings of ``n`` characters: rows of matrices. The plain version that ``natural_counts`` is tested against.

    A string begins at the first word from every n-th character on, so strings
    cover a text from its start to where fewer than n characters are left. The
    sign between words is ``_`` or, by ``signs``, ``-``.
    """
    raw = np.frombuffer("\n".join(texts).encode(), np.uint8)
    gap, end = raw == 32, raw == 10
    first = ~gap & ~end & np.r_[True, (gap | end)[:-1]]
    text = np.cumsum(end) - end
    if encoding == "base64":
        chars, kept = np.where(gap, np.where(np.array(signs, bool)[text], 45, 95), raw).astype(np.uint8), ~end
    else:
        small = np.where(first & (encoding == "alnum"), raw - 32, raw)
        chars, kept = (small - 32 if encoding == "base32" else small).astype(np.uint8), ~(gap | end)
    chars, first, text = chars[kept], np.flatnonzero(first[kept]), text[kept]
    size = np.bincount(text, minlength=len(texts))
    start = np.cumsum(size) - size
    of = text[first]
    turn = (first - start[of]) // n
    begins = np.r_[True, (turn[1:] != turn[:-1]) | (of[1:] != of[:-1])] if len(first) else np.zeros(0, bool)
    first = first[begins & (first + n <= (start + size)[of])]
    for lo in range(0, len(first), at_once):
        found = chars[first[lo : lo + at_once, None] + np.arange(n)]
        if encoding in ("lower", "base32"):  # such strings of a to f are hexadecimal
            found = found[((found | 32) > ord("f")).any(1)]
        if len(found):
            yield found


def _bits(planes: list[str], code: int, mask: str = "m") -> str:
    """SQL: the places whose bits in ``planes``, lowest first, are those of ``code``."""
    return " & ".join([mask, *(p if code >> b & 1 else f"~{p}" for b, p in enumerate(planes))])


def _natural_tests(strings: DataFrame) -> DataFrame:
    """``s, encoding, bin`` of natural strings given by bits: what ``battery_bins`` finds, in arithmetic on longs.

    Of a string of ``n`` characters, ``p0`` to ``p4`` hold the bits of the letters'
    places in the alphabet, ``f`` the capitals (d = -26) or the signs (d = 38 or
    39), a bit for each character, the first the highest. So a letter's count is a
    number of bits, and so is each part of the sums: but for a constant, a code is
    the letter's place and, where ``f`` is set, d.
    """
    five = [f"p{b}" for b in range(5)]
    given = strings.selectExpr("*", "shiftrightunsigned(-1L, 64 - n) AS m")
    parts = given.selectExpr("*", *(f"{_bits(five[2:], j)} AS h{j}" for j in range(7)), *(f"{_bits(five[:2], j)} AS l{j}" for j in range(4)))
    total = lambda terms: "CAST(" + " + ".join(terms) + " AS DOUBLE)"
    next_to = lambda x, y: f"bit_count(shiftrightunsigned({x}, 1) & {y})"
    at_end = lambda x: f"CAST((shiftrightunsigned({x}, n - 1) & 1L) + ({x} & 1L) AS INT)"
    changes = lambda g: f"CAST(bit_count((({g}) ^ shiftrightunsigned({g}, 1)) & shiftrightunsigned(m, 1)) AS DOUBLE)"
    # With more than a hundred columns Spark compiles these two steps in small methods; one large method is more than the JVM compiles, and slow.
    counts = parts.selectExpr(
        "CAST(n AS DOUBLE) AS n", "CAST(d AS DOUBLE) AS d", "(p4 | p3 | (p2 & p1)) = 0 AS hexadecimal", f"{changes('p4 | (p3 & p2 & (p1 | p0))')} AS upper_half", f"{changes('f')} AS upper_f",
        *(f"bit_count(h{c >> 2} & l{c & 3} & ~f) AS r{c}" for c in range(26)), *(f"bit_count(h{c >> 2} & l{c & 3} & f) AS a{c}" for c in range(26)), *(f"bit_count(h{c >> 2} & l{c & 3}) AS t{c}" for c in range(26)), "bit_count(f) AS ff",
        *(f"{next_to(f'p{a}', f'p{b}')} AS n{a}{b}" for a in range(5) for b in range(5)), *(f"{next_to(f'p{b}', 'f')} AS nf{b}" for b in range(5)), *(f"{next_to('f', f'p{b}')} AS fn{b}" for b in range(5)), f"{next_to('f', 'f')} AS lff",
        *(f"{at_end(f'p{b}')} AS e{b}" for b in range(5)), f"{at_end('f')} AS ef",
    )
    sums = counts.selectExpr(
        "n", "d", "hexadecimal", "upper_half", "upper_f", "CAST(ff AS DOUBLE) AS ff", "CAST(lff AS DOUBLE) AS lff", "CAST(ef AS DOUBLE) AS ef",
        total(f"t{c} * t{c}" for c in range(26)) + " AS same", total(f"a{c} * a{c} + r{c} * r{c}" for c in range(26)) + " AS same_f",
        total(f"{c} * t{c}" for c in range(26)) + " AS x", total(f"{c * c} * t{c}" for c in range(26)) + " AS xx", total(f"{c} * a{c}" for c in range(26)) + " AS xf",
        total(f"{1 << a + b} * n{a}{b}" for a in range(5) for b in range(5)) + " AS lxx", total(f"{1 << b} * (nf{b} + fn{b})" for b in range(5)) + " AS lxf", total(f"{1 << b} * e{b}" for b in range(5)) + " AS ex",
    )
    shares = {n: [sum(map(t, a)) / len(a) for t in (str.isdigit, str.isupper, str.islower, lambda c: not c.isalnum())] for n, _, a in ENCODINGS}
    size = {n: len(a) for n, _, a in ENCODINGS}

    def test(e: str, d: str, same: str, changed: str) -> str:
        middle = max(shares[e]) == 1
        q = 1 - (0.5 if middle else sum(v**2 for v in shares[e]))
        both = 2 * q - 1 + (0.25 if middle else sum(v**3 for v in shares[e]))
        return f"named_struct('encoding', '{e}', 'k', {size[e]}D, 'q', {q!r}D, 'both', {both!r}D, 'd', {d}, 'sq', {same}, 'chg', {changed}, 'kept', " + ("NOT hexadecimal)" if e in ("lower", "base32") else "true)")

    plain = f"array({test('lower', '0D', 'same', 'upper_half')}, {test('base32', '0D', 'same', '0D')}, {test('alnum', 'd', 'same_f', 'upper_f')})"
    each = sums.selectExpr("*", f"explode(IF(d < 0, {plain}, array({test('base64', 'd', 'same_f', 'upper_f')}))) AS e").filter("e.kept")
    moments = each.selectExpr("n", "e.encoding", "e.k", "e.q", "e.both", "e.chg", "e.sq * e.k / n - n AS chi", "(x + e.d * ff) / n AS mean", "xx + 2 * e.d * xf + e.d * e.d * ff AS squares", "lxx + e.d * lxf + e.d * e.d * lff AS next", "ex + e.d * ef AS ends")
    values = moments.selectExpr(
        "n", "encoding",
        _upper_tail("(power(greatest(chi, 0D) / (k - 1), 1D/3) - (1 - 2/(9*(k - 1)))) / sqrt(2/(9*(k - 1)))") + " AS chi_p",
        "least(1D, 2 * " + _upper_tail("abs(chg - (n - 1) * q) / sqrt(greatest(1e-9D, (n - 1) * q * (1 - q) + 2 * (n - 2) * (both - q * q)))") + ") AS runs_p",
        "least(1D, 2 * " + _upper_tail("abs((next - mean * (2 * n * mean - ends) + (n - 1) * mean * mean) / greatest(1e-9D, squares - n * mean * mean) + 1 / n) * sqrt(n)") + ") AS serial_p",
    )
    combined = values.selectExpr("n", "encoding", "-ln(greatest(1e-300D, chi_p)) - ln(greatest(1e-300D, runs_p)) - ln(greatest(1e-300D, serial_p)) AS f")
    stratum = "CASE CAST(n AS INT) " + " ".join(f"WHEN {n} THEN {s}" for s, n in enumerate(STRATA)) + " END"
    return combined.selectExpr(f"{stratum} AS s", "encoding", f"CAST(least({BINS - 1}D, greatest(0D, floor(-{PER_DECADE}D * log10(exp(-least(f, 600D)) * (1 + f + f * f / 2))))) AS INT) AS bin")


def natural_counts(given: DataFrame, wanted: set[tuple[int, str]] | None = None) -> dict:
    """How often each (stratum, encoding, bin) occurs among natural strings: those of all words of the column ``__text``, and ``DRAWN`` sequences with the letters of prose.

    Words have two to twelve letters. Every text is cut whole, in each form and
    into the least length of each stratum: from every n-th character on, the
    string that begins at the first word. Texts go in blocks of ``CUT`` characters
    and what a string may reach beyond; a string is a few longs of bits. Counts of
    the ``wanted`` (stratum, encoding), all by default, are whole; of others they may
    be left out. At most strata times forms times bins counts reach the driver.
    """
    lengths = [[n for s, n in enumerate(STRATA) if wanted is None or any((s, e) in wanted for e in encodings)] for encodings in (FORMED[:-1], FORMED[-1:])]
    if not any(lengths):
        return {}
    some = given.select(F.regexp_extract_all("__text", F.lit(r"\b[A-Za-z][a-z]{1,11}\b"), F.lit(0)).alias("w"))
    words = some.select(F.array_join("w", " ").alias("t"), F.expr("hash(w) % 2 <> 0").alias("sign"))
    letter = f"substring('{LETTERS}', CAST(pmod(xxhash64(id, i, j), {len(LETTERS)}) + 1 AS INT), 1)"
    drawn = given.sparkSession.range(DRAWN).select(F.expr(f"array_join(transform(sequence(1, 32), i -> array_join(transform(sequence(0, CAST(1 + pmod(xxhash64(id, i), 8) AS INT)), j -> {letter}), '')), ' ')").alias("t"), F.expr("id % 2 = 0").alias("sign"))
    # Words with a capital each, so that a block shows where they begin: run together, and joined by a sign.
    texts = words.unionByName(drawn).select(F.initcap("t").alias("t"), "sign")
    forms = ["named_struct('d', -26, 't', replace(t, ' ', ''))", "IF(sign, named_struct('d', 38, 't', replace(t, ' ', '-')), named_struct('d', 39, 't', replace(t, ' ', '_')))"]
    formed = texts.selectExpr(f"explode(array({', '.join(x for x, some in zip(forms, lengths, strict=True) if some)})) AS x")
    cut = f"transform(sequence(0, (length(x.t) - 1) DIV {CUT}), i -> substring(b, i * {CUT} + 1, {CUT + 2 * STRATA[-1]}))"
    blocks = formed.select("x.d", F.expr(f"explode(transform(array(CAST(x.t AS BINARY)), b -> {cut})[0])").alias("b")).select("d", F.expr("coalesce(CAST(b AS STRING), '')").alias("b"))
    small = "abcdefghijklmnopqrstuvwxyz"
    plane = lambda low, high, sign: f"CAST(translate(b, '{small}{small.upper()}-_', '{low}{high}{sign * 2}') AS BINARY)"
    bits = ["".join(str(c >> b & 1) for c in range(26)) for b in range(5)]
    planes = blocks.selectExpr("d", f"{plane('0' * 26, '1' * 26, '0')} AS u", f"IF(d < 0, NULL, {plane('0' * 26, '0' * 26, '1')}) AS v", *(f"{plane(x, x, '0')} AS c{b}" for b, x in enumerate(bits)))
    cells = [f"CAST(array({', '.join(str(n << 12 | at) for n in some for at in range(0, CUT, n))}) AS array<int>)" for some in lengths]
    at = planes.selectExpr("*", f"explode(IF(d < 0, {cells[0]}, {cells[1]})) AS cell").selectExpr("d", "u", "v", *(f"c{b}" for b in range(5)), "shiftright(cell, 12) AS n", "cell & 4095 AS at").filter("at < length(u)")
    first = at.selectExpr("*", "instr(CAST(substring(u, at + 1, n) AS STRING), '1') AS skip").filter("skip > 0 AND at + skip - 1 + n <= length(u)")
    number = lambda p: f"coalesce(CAST(conv(CAST(substring({p}, at + skip, n) AS STRING), 2, -10) AS BIGINT), 0L)"
    strings = first.selectExpr("n", "d", f"{number('IF(d < 0, u, v)')} AS f", *(f"{number(f'c{b}')} AS p{b}" for b in range(5)))
    return {(r["s"], r["encoding"], r["bin"]): r["count"] for r in _natural_tests(strings).groupBy("s", "encoding", "bin").count().collect()}


def random_bars(docs: DataFrame, text_col: str = "text", fdr: float = FDR) -> dict[tuple[int, str], int]:
    """Per (length stratum, encoding) the last ``bin`` of the battery that the Benjamini-Hochberg rule accepts over all candidates; -1 accepts none.

    What must not be reported is natural text, so a candidate's battery value is
    held against that of natural strings of the same encoding and of the
    stratum's least length, made from the words of all texts: its p-value is the
    share of them that look as random. Short strings, where words pass for random
    too, need more than long ones. Where the table has no candidates, no natural
    strings are counted, and none is accepted. At most strata times encodings times bins
    counts reach the driver, for candidates and for natural strings.
    """
    given = docs.select(text_of(text_col).alias("__text"))
    at = given.filter(F.col("__text").rlike(CANDIDATE)).select(F.explode(_located("__text", CANDIDATE, 0, STRATA[0], "random")).alias("x"))
    found = _counts(at.select(F.col("x.word").alias("word"), (F.col("x.end") - F.col("x.start")).alias("n")))
    if not found:
        return {}
    null = natural_counts(given, {(s, NULL_OF[e]) for s, e, _ in found if e in NULL_OF})
    bars: dict[tuple[int, str], int] = {}
    for s in range(len(STRATA)):
        p: dict[tuple[str, int], float] = {}
        for e, like in NULL_OF.items():
            total = sum(v for (t, f, _), v in null.items() if (t, f) == (s, like))
            below = 0
            for b in range(BINS - 1):
                below += null.get((s, like, b), 0)
                p[e, b] = (1 + below) / (1 + total)
        tests = sorted((p[e, b], v) for (t, e, b), v in found.items() if t == s and (e, b) in p)
        total, seen, cut = sum(v for (t, _, _), v in found.items() if t == s), 0, -1.0
        for q, v in tests:
            seen += v
            if q * total <= fdr * seen:
                cut = q
        for e in NULL_OF:
            bars[s, e] = max((b for b in range(BINS - 1) if p[e, b] <= cut), default=-1)
    return bars


def secret_spans(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, bars: dict[tuple[int, str], int] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) and ``secrets``: ``array<struct<start,end,kind>>`` by start, then kind.

    Base forms are always reported. The battery adds ``random`` spans: strings of
    20 characters and more that it accepts at their stratum's and encoding's bar,
    where they touch no base span. Positions are code points, the end exclusive.
    Narrow passes, one each for candidates, natural strings and spans; nothing is
    shuffled but the bounded counts. Null and empty texts have no spans; repeated
    rows get the same spans each; an input column ``secrets`` is replaced; an
    empty table gives none.
    """
    bars = random_bars(docs, text_col) if bars is None else bars
    names = [c for c in (docs.columns if carry is None else carry) if c not in ("secrets", "__text")]
    given = docs.select(*names, text_of(text_col).alias("__text"))
    kinds = [f"__{k}" for k, *_ in FORMS]
    base = given.select(*names, *(_located("__text", p, g, n, k).alias(f"__{k}") for k, p, g, n in FORMS), _located("__text", CANDIDATE, 0, STRATA[0], "random").alias("__at"))
    joined = base.select(*names, F.concat(*kinds).alias("__base"), "__at")
    # What begins before a base span ends, or ends after one begins, touches it: one way each over all spans in order.
    flagged = "struct<start:int,end:int,kind:string,word:string,free:boolean>"
    item = "named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'word', x.word, 'free', {})"
    forward = _scan("array_sort(concat(__base, __at))", "0", flagged, "IF(x.kind <> 'random', greatest(c.s, x.end), c.s)", item.format("c.s <= x.start"))
    backward = _scan(f"reverse({forward})", "2147483647", flagged, "IF(x.kind <> 'random', least(c.s, x.start), c.s)", item.format("x.free AND c.s >= x.end"))
    free = joined.withColumn("__at", F.expr(f"CASE WHEN size(__at) = 0 OR size(__base) = 0 THEN __at ELSE transform(filter({backward}, x -> x.free AND x.kind = 'random'), x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'word', x.word)) END"))
    stratum = "CASE " + " ".join(f"WHEN x.end - x.start >= {lo} THEN {s}" for s, lo in reversed(list(enumerate(STRATA)))) + " END"
    allowed = " ".join(f"WHEN '{s}{e}' THEN {b}" for (s, e), b in bars.items() if b >= 0)
    bar = f"CASE concat({stratum}, x.test.encoding) {allowed} ELSE -1 END" if allowed else "-1"
    tested = f"transform(__at, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'test', {battery_sql('x.word')}))" if allowed else "CAST(NULL AS array<struct<start:int,end:int,kind:string,test:struct<encoding:string,bin:int>>>)"
    chosen = free.withColumn("__at", F.expr(f"coalesce(transform(filter({tested}, x -> x.test.bin <= {bar}), x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)), CAST(array() AS array<{_SPAN}>))"))
    rank = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, (k, *_) in enumerate(FORMS)) + f" ELSE {len(FORMS)} END"
    merged = f"concat(transform(__base, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)), __at)"
    ordered = f"transform(array_sort(transform({merged}, x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, 'kind', x.kind))), x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind))"
    return chosen.select(*names, F.expr(ordered).alias("secrets"))


def redact_secrets(docs: DataFrame, text_col: str = "text", bars: dict[tuple[int, str], int] | None = None) -> DataFrame:
    """All rows and columns, each secret span of the text replaced by ``[SECRET]``; overlapping spans are one.

    A null text stays null. The text is cut in blocks of spans and each block by
    its spans, so that very many spans don't walk through the whole text each.
    """
    found = secret_spans(docs, text_col, bars=bars)
    # ``free`` is where the text that is kept before a span begins: the furthest end so far; covered spans keep nothing.
    pieces = _scan("secrets", "0", "struct<free:int,start:int,end:int>", "greatest(c.s, x.end)", "named_struct('free', c.s, 'start', x.start, 'end', x.end)")
    kept = found.withColumn("__cuts", F.expr(f"filter({pieces}, x -> x.start >= x.free)"))
    blocks = f"transform(sequence(0, (size(__cuts) - 1) DIV {BLOCK}), i -> slice(__cuts, CAST(i * {BLOCK} + 1 AS INT), {BLOCK}))"
    near = f"transform({blocks}, b -> named_struct('at', b[0].free, 'cuts', b, 'part', substring(`{text_col}`, b[0].free + 1, b[size(b) - 1].start - b[0].free)))"
    written = f"flatten(transform({near}, b -> transform(b.cuts, x -> concat(substring(b.part, x.free - b.at + 1, x.start - x.free), '[SECRET]'))))"
    last = "aggregate(secrets, 0, (t, x) -> greatest(t, x.end))"
    clean = F.expr(f"CASE WHEN size(secrets) = 0 OR `{text_col}` IS NULL THEN `{text_col}` ELSE concat(array_join({written}, ''), substring(`{text_col}`, {last} + 1)) END")
    return kept.withColumn(text_col, clean).drop("secrets", "__cuts")


def op6_secret_scans(spark, sf_dir):
    """Counts, digest and list of the spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secret_spans(docs, carry=["doc_id"])
    shown = lambda s: F.expr(f"array_join(transform({s}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
    count = lambda k: F.expr(f"CAST(size(filter(secrets, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}")
    base = found.withColumn("base", F.expr("filter(secrets, x -> x.kind <> 'random')"))
    return base.select("doc_id", *(count(k) for k, *_ in FORMS), F.sha2(shown("base"), 256).alias("base_sha256"), shown("secrets").alias("spans"), count("random"))
