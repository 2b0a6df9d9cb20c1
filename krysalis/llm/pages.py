"""HTML extraction: leaf blocks of a page, labelled by a bidirectional LSTM."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from krysalis.llm.common import text_of

#: Elements that start a block, those without content, and those whose content is no text.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = BLOCK_TAGS - frozenset("p h1 h2 h3 h4 h5 h6 li dt dd option hr".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_NAMES = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-zA-Z]+")
#: Sizes: hashed tag, name and word vectors, plain figures; units of a direction.
TAGS, NAMES, WORDS, PLAIN, UNITS = 64, 96, 32, 7, 16
WIDTH = TAGS + NAMES + WORDS + PLAIN
#: Pages that the labeller is fitted on, steps and seed.
SAMPLE, STEPS, SEED = 384, 160, 7


def leaf_blocks(page: str) -> list[tuple[str, tuple[str, ...], tuple[str, ...], int]]:
    """``(text, tags of the path, names of the path, linked characters)`` of each block with text, in page order.

    Text is decoded, its white space turned into single spaces. Comments,
    scripts, styles and markup are no text. A line break inside a block is white
    space. Unclosed elements are closed where the next block of their kind or
    the end of their container comes.
    """
    out: list = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, tuple(t for t, _ in stack), tuple(n for _, names in stack for n in names), linked))
            parts.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if any(t == "a" for t, _ in stack):
                linked += m.start() - at
        at = m.end()
        tag = m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m.group(2):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in CONTAINERS and tag not in CONTAINERS:
                    break
            continue
        if tag in VOID_TAGS or m.group(4).endswith("/"):
            continue
        if tag in BLOCK_TAGS:
            ends = {tag} if tag in ("li", "option") else {"dt", "dd"} if tag in ("dt", "dd") else {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in CONTAINERS:
                    break
        names = tuple(w.lower() for x in _NAMES.findall(m.group(4)) for w in _WORD.findall(" ".join(x))) if "=" in m.group(4) else ()
        stack.append((tag, names))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def features(blocks: list) -> np.ndarray:
    """One row per block: hashed tag path, hashed names of the path, hashed words, plain figures."""
    x = np.zeros((len(blocks), WIDTH), np.float32)
    for k, (text, tags, names, linked) in enumerate(blocks):
        for t in tags:
            x[k, _slot(t, TAGS)] = 1
        if tags:
            x[k, _slot("leaf " + tags[-1], TAGS)] = 1
        for n in names:
            x[k, TAGS + _slot(n, NAMES)] = 1
        words = text.lower().split()
        for w in words:
            x[k, TAGS + NAMES + _slot(w, WORDS)] += 1 / len(words)
        n = len(text)
        x[k, -PLAIN:] = (np.log1p(n) / 8, min(1, linked / n), min(1, 20 * sum(map(text.count, ".!?")) / n), text[-1] in ".!?", k / len(blocks), len(tags) / 16, min(1, len(names) / 4))
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over the blocks of a page with a logistic output for each block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w |= {f"x{d}": draw(WIDTH, 4 * UNITS), f"h{d}": draw(UNITS, 4 * UNITS), f"c{d}": np.zeros(4 * UNITS, np.float32)}
            self.w[f"c{d}"][UNITS : 2 * UNITS] = 1
        self.w |= {"o": draw(2 * UNITS, 1), "s": np.zeros((WIDTH, 1), np.float32), "p": np.zeros(1, np.float32)}

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray, trace: bool):
        n, steps, _ = x.shape
        z = x.reshape(n * steps, -1) @ self.w[f"x{d}"] + self.w[f"c{d}"]
        z = z.reshape(n, steps, -1)
        h = np.zeros((n, UNITS), np.float32)
        c = np.zeros((n, UNITS), np.float32)
        hs, kept = np.zeros((n, steps, UNITS), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[:, t] + h @ self.w[f"h{d}"]
            i, f, o = (_sigmoid(a[:, k * UNITS : (k + 1) * UNITS]) for k in range(3))
            g = np.tanh(a[:, 3 * UNITS :])
            m = mask[:, t : t + 1]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if trace:
                kept.append((t, h, c, i, f, o, g, th, m))
            h, c = m * (o * th) + (1 - m) * h, m * c2 + (1 - m) * c
            hs[:, t] = h
        return hs, kept

    def forward(self, x: np.ndarray, mask: np.ndarray, trace: bool = False):
        """Chance of each block of padded pages to be main text."""
        hf, kf = self._pass("f", x, mask, trace)
        hb, kb = self._pass("b", x, mask, trace)
        both = np.concatenate([hf, hb], 2)
        y = _sigmoid((both @ self.w["o"] + x @ self.w["s"])[..., 0] + self.w["p"])
        return y, both, kf, kb

    def gradients(self, x, mask, label):
        y, both, kf, kb = self.forward(x, mask, True)
        e = ((y - label) * mask / mask.sum())[..., None].astype(np.float32)
        g = {"o": np.einsum("nth,nto->ho", both, e), "s": np.einsum("ntd,nto->do", x, e), "p": e.sum((0, 1))}
        back = e @ self.w["o"].T
        for d, kept, dh_all in (("f", kf, back[..., :UNITS]), ("b", kb, back[..., UNITS:])):
            dz = np.zeros((*x.shape[:2], 4 * UNITS), np.float32)
            gh = np.zeros_like(self.w[f"h{d}"])
            dh = np.zeros((len(x), UNITS), np.float32)
            dc = np.zeros_like(dh)
            for t, h, c, i, f, o, gg, th, m in reversed(kept):
                dh = dh + dh_all[:, t]
                new = dh * m
                do = new * th * o * (1 - o)
                dct = dc * m + new * o * (1 - th * th)
                a = np.concatenate([dct * gg * i * (1 - i), dct * c * f * (1 - f), do, dct * i * (1 - gg * gg)], 1)
                dz[:, t] = a
                gh += h.T @ a
                dh = dh * (1 - m) + a @ self.w[f"h{d}"].T
                dc = dc * (1 - m) + dct * f
            g |= {f"x{d}": np.einsum("ntd,ntk->dk", x, dz), f"h{d}": gh, f"c{d}": dz.sum((0, 1))}
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, batch: int = 32, rate: float = 0.01, seed: int = SEED) -> Labeller:
        """Adam on (features, labels) of whole pages; pages of over 200 blocks are cut for fitting only."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        for step in range(1, steps + 1 if pages else 0):
            x, mask, y = padded([(p[0][:200], p[1][:200]) for p in (pages[k] for k in rng.integers(0, len(pages), batch))])
            for k, g in self.gradients(x, mask, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray], at_once: int = 4096) -> list[np.ndarray]:
        """True for each block of main text; pages of like length go together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[-1]])
            part = order[-max(1, at_once // longest) :]
            del order[-len(part) :]
            x, mask, _ = padded([(pages[k], None) for k in part])
            y = self.forward(x, mask)[0]
            for row, k in zip(y, part, strict=True):
                out[k] = row[: len(pages[k])] > 0.5
        return out


def padded(pages: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(len(x) for x, _ in pages)
    x = np.zeros((len(pages), longest, WIDTH), np.float32)
    mask, y = np.zeros((2, len(pages), longest), np.float32)
    for k, (a, b) in enumerate(pages):
        x[k, : len(a)], mask[k, : len(a)] = a, 1
        if b is not None:
            y[k, : len(a)] = b
    return x, mask, y


#: What pages put around their text, as (opening, closing) with the text between them.
_OUTSIDE = (
    ('<aside class="sidebar"><h3>', "</h3></aside>"), ('<div class="sidebar widget"><ul><li><a href="#">', "</a></li></ul></div>"), ('<div id="sidebar"><p>', "</p></div>"),
    ('<div class="cookie-notice"><p>', "</p></div>"), ('<div class="notice banner" role="alert">', "</div>"), ('<div class="consent popup">', "</div>"),
    ('<form action="/s" class="search"><label>', '</label><input name="q"><button>Go</button></form>'), ('<form class="newsletter subscribe"><p>', "</p></form>"),
    ('<section class="comments" id="comments"><div class="comment"><p>', "</p></div></section>"), ('<div class="comment-list"><p>', "</p></div>"), ('<ol class="commentlist"><li class="comment">', "</li></ol>"), ('<div id="disqus" class="replies"><p>', "</p></div>"),
    ('<div class="ad">', "</div>"), ('<div class="ads advert sponsored"><p>', "</p></div>"), ('<div class="promo banner-ad"><p>', "</p></div>"),
    ('<div class="related"><h4>', "</h4></div>"), ('<div class="share social"><a href="#">', "</a></div>"), ('<div class="breadcrumbs"><a href="/">', "</a></div>"),
    ('<header class="site-header"><h2>', "</h2></header>"), ('<div class="header"><p>', "</p></div>"), ('<nav class="menu"><a href="/">', "</a></nav>"), ('<div class="menu navbar"><ul><li><a href="/">', "</a></li></ul></div>"),
    ('<footer><p>', "</p></footer>"), ('<div class="footer copyright"><p>', "</p></div>"),
)
_INSIDE = (("<article>", "</article>"), ("<main>", "</main>"), ('<main><article class="post">', "</article></main>"), ('<div class="content">', "</div>"), ('<div class="article-body entry">', "</div>"), ('<section class="post-content">', "</section>"), ('<div id="main" class="story text">', "</div>"), ("<div><article>", "</article></div>"))
_NOT_MAIN = frozenset("nav aside footer form head title header script style button label".split())
_ARTICLE = re.compile(r"<article\b[^>]*>(.*?)(?:</article\s*>|\Z)", re.S | re.I)


def weak_labels(blocks: list) -> np.ndarray:
    """Labels of a page as it is: inside ``article`` or ``main``, outside the elements for everything else."""
    return np.array([bool({"article", "main"} & set(tags)) and not _NOT_MAIN & set(tags) for _, tags, _, _ in blocks], np.float32)


def varied(page: str, rng: np.random.Generator) -> tuple[list, np.ndarray] | None:
    """The page's article in another frame, with surroundings of known kind before, after and inside it; and its labels."""
    found = _ARTICLE.search(page)
    if not found:
        return None
    others = [b[0] for b in leaf_blocks(page[: found.start()] + page[found.end() :])] or ["Home"]
    mine = [b[0] for b in leaf_blocks(found.group(1))]

    def outside() -> str:
        a, b = _OUTSIDE[rng.integers(len(_OUTSIDE))]
        words = str(rng.choice(others if rng.random() < 0.6 or not mine else mine))
        return f"\ue000{a}{html.escape(words)}{b}\ue001"

    a, b = _INSIDE[rng.integers(len(_INSIDE))]
    inner = found.group(1)
    cut = [m.start() for m in re.finditer(r"<p\b", inner)]
    for at in sorted((cut[k] for k in rng.integers(0, len(cut), rng.integers(0, 3))), reverse=True) if cut else []:
        inner = inner[:at] + outside() + inner[at:]
    frame = "".join(outside() for _ in range(rng.integers(0, 5)))
    after = "".join(outside() for _ in range(rng.integers(0, 5)))
    page = f"<html><head><title>x</title></head><body>{frame}{a}{inner}{b}{after}</body></html>"
    # The marks around inserted parts say which blocks they gave: text without marks is the article's.
    spans = re.split("([\ue000\ue001])", page)
    inserted, depth = [], 0
    for s in spans:
        depth += (s == "\ue000") - (s == "\ue001")
        if s not in ("\ue000", "\ue001") and depth:
            inserted.append(s)
    blocks = leaf_blocks(page.replace("\ue000", "").replace("\ue001", ""))
    left: dict[str, int] = {}
    for s in inserted:
        for t, tags, *_ in leaf_blocks(s):
            left[t] = left.get(t, 0) + 1
    label = []
    for t, tags, names, _ in blocks:
        extra = left.get(t, 0) > 0 and bool(_FRAME_NAMES & set(names) or _NOT_MAIN & set(tags))
        left[t] = left.get(t, 0) - extra
        label.append(not extra and t != "x" and "head" not in tags)
    return blocks, np.array(label, np.float32)


_FRAME_NAMES = frozenset(w for a, _ in _OUTSIDE for x in _NAMES.findall(a) for w in _WORD.findall(" ".join(x).lower()))


def fitted_labeller(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = SAMPLE, steps: int = STEPS, seed: int = SEED) -> Labeller:
    """A labeller fitted on a bounded sample: the ``sample`` pages of least hashed id, or a few less.

    Labels come from the elements that say what they hold (``weak_labels``) and
    from the same articles put into other frames (``varied``), so that the
    network learns names, places and neighbours and not one template.
    """
    # Hashes under a bound leave some 2 * sample rows of the whole table, so few reach the driver from however many tasks.
    n = pages.count()
    hashed = pages.withColumn("h", F.pmod(F.xxhash64(id_col), F.lit(1 << 40)))
    near = hashed.filter(F.col("h") < int((1 << 40) * min(1.0, 2 * sample / max(n, 1)))).filter(F.length(html_col) < 1_000_000)
    rows = near.select(F.col(html_col), "h").orderBy("h").limit(sample).collect()
    rng = np.random.default_rng(seed)
    data = []
    for row in rows:
        blocks = leaf_blocks(row[0])
        if blocks:
            data.append((features(blocks), weak_labels(blocks)))
        other = varied(row[0], rng)
        if other and other[0]:
            data.append((features(other[0]), other[1]))
    return Labeller(seed).fit(data, steps)


def extract_text(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None, labeller: Labeller | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) with ``text``, the main text, and ``n_chars``.

    Every page is cut into blocks and each block is labelled in the context of
    all the page's blocks; those of main text are joined by line breaks in page
    order. One narrow pass; the fitted weights, some 40,000 numbers, go with
    the tasks. Null or empty html gives an empty text; repeated rows are rows of
    their own; input columns called ``text`` or ``n_chars`` are replaced.
    """
    model = labeller or fitted_labeller(pages, html_col)
    names = [c for c in (pages.columns if carry is None else carry) if c not in ("text", "n_chars")]
    given = pages.select(*names, text_of(html_col).alias("__html"))
    weights = model.w

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller()
        own.w = weights
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                blocks = [leaf_blocks(h) for h in part.column(part.num_columns - 1).to_pylist()]
                marks = own.label([features(b) for b in blocks])
                texts = ["\n".join(b[0] for b, m in zip(bs, ms, strict=True) if m) for bs, ms in zip(blocks, marks, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return given.mapInArrow(run, StructType([*given.schema.fields[:-1], StructField("text", StringType()), StructField("n_chars", LongType())]))


def op7_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), carry=["page_id", "url"]).select("page_id", "url", "text", "n_chars")
