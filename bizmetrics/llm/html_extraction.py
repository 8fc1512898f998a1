"""Main text of web pages: a bidirectional LSTM labels every block of a page from the whole page's block sequence.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, without comments, scripts and
styles, with character references decoded. Each block has a vector of its tag path (open elements with their class,
id and role words, hashed), its words (hashed), and a few sizes. The network, written in numpy, reads the sequence in
both directions and gives each block the probability of belonging to the article.

It is trained here, on a bounded sample of pages (``train_pages``, those with the lowest hash). The labels come from
page structure where it is plain: blocks inside ``article`` or ``main`` and outside menus, adverts, forms, comments and
the like are article; on a page without such elements, the container with the most unlinked running text takes their place. Each sampled page is also shown in altered forms, with other containers around the article and
other boilerplate in and around it, so the labels do not hang on one element. Labelling runs on all blocks of
all pages, pages of similar length side by side.

Defined results: null or empty html, and pages without an article block, give an empty text with 0 characters; text
after a tag that never ends is dropped, as browsers do; equal pages get equal texts; without any page to learn from,
an untrained network is replaced by the structural labels; other columns of the input are ignored; an empty table
gives no rows. White space is space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import html as html_module
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizmetrics.llm import hashing

# Fixed values of HTML.
BREAKING = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav noscript ol option p pre section select "
    "summary table tbody td textarea tfoot th thead title tr ul iframe".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS_PARAGRAPH = BREAKING - {"body", "button", "head", "html", "iframe", "label", "legend", "option", "select", "textarea", "title"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|svg|math|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][a-z0-9-]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-z/][^>]*\Z"
    r"|[^<]+|<",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
SPACES = re.compile(r"[\x20\x09-\x0D]+")
NAME_PARTS = re.compile(r"[a-z]+")

# Words in class, id and role that mark what is not the article, and elements that do.
NOT_ARTICLE_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent footer header menu "
    "nav navbar navigation newsletter notice popup promo related share sharing sidebar signup social sponsored subscribe "
    "toolbar widget discussion replies contentinfo complementary search login".split()
)
NOT_ARTICLE_TAGS = frozenset("nav footer header aside form head title button select label noscript menu dialog".split())
ARTICLE_TAGS = frozenset({"article", "main"})
WHOLE_PAGE = ARTICLE_TAGS | {"html", "body"}
INNER_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption caption center".split())

PATH_SIZE, WORD_SIZE, SIZES = 64, 24, 5
HIDDEN = 16


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """Leaf blocks in page order: tag path (elements, and ``.word`` for class, id and role words), text, linked characters."""
    found: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # open block elements with their path entries
    parts: list[str] = []
    linked, in_link = 0, 0

    def close_block():
        nonlocal parts, linked
        if parts:
            text = SPACES.sub(" ", html_module.unescape("".join(parts))).strip(" ")
            if text:
                found.append((tuple(entry for _, own in stack for entry in own), text, linked))
        parts, linked = [], 0

    for token in TOKEN.finditer(page or ""):
        whole = token[0]
        if whole[0] != "<" or whole == "<":
            parts.append(whole)
            if in_link:
                linked += len(whole)
            continue
        name = token[3] or token[6]
        if not name:
            continue
        name, ending, rest = name.lower(), token[2] or token[5], token[4] or token[7] or ""
        if name == "a":
            in_link = 0 if ending else 1
        elif name == "br":
            parts.append(" ")
        elif name in BREAKING:
            close_block()
            if ending:
                if any(opened == name for opened, _ in stack):
                    while stack.pop()[0] != name:
                        pass
            elif name not in VOID:
                gone = CLOSES.get(name, {"p"} if name in ENDS_PARAGRAPH else ())
                while stack and stack[-1][0] in gone:
                    stack.pop()
                own = [name]
                if "=" in rest:
                    for _, a, b, c in ATTRIBUTE.findall(rest):
                        own += ["." + word for word in NAME_PARTS.findall((a or b or c).lower())]
                stack.append((name, tuple(own)))
    close_block()
    return found


def structural_label(path: tuple[str, ...]) -> int:
    """1 inside an article element and outside everything that marks boilerplate.

    Class, id and role words of ``html``, ``body`` and the article elements speak of the page and do not count.
    """
    if not ARTICLE_TAGS.intersection(path):
        return 0
    element = ""
    for e in path:
        if e[0] != ".":
            element = e
            if e in NOT_ARTICLE_TAGS:
                return 0
        elif e[1:] in NOT_ARTICLE_WORDS and element not in WHOLE_PAGE:
            return 0
    return 1


def marked_article(sequence: list[tuple[tuple[str, ...], str, int]]) -> list[tuple[tuple[str, ...], str, int]]:
    """The page with an article element around what reads as one, for training on pages without such an element.

    The container is the element with the most unlinked text in blocks of 80 characters or more outside
    boilerplate, counting blocks that stand in it directly or inside headings, lists, quotes and tables.
    """

    def boilerplate(path):
        element = ""
        for e in path:
            if e[0] != ".":
                element = e
            if e in NOT_ARTICLE_TAGS or e[0] == "." and e[1:] in NOT_ARTICLE_WORDS and element not in WHOLE_PAGE:
                return True
        return False

    def container(path):
        starts = [i for i, e in enumerate(path) if e[0] != "."] + [len(path)]
        depth = len(starts) - 1
        while depth and path[starts[depth - 1]] in INNER_TAGS:
            depth -= 1
        return path[: starts[depth]]

    weight: dict[tuple[str, ...], int] = {}
    for path, text, linked in sequence:
        if len(text) >= 80 and 2 * linked <= len(text) and not boilerplate(path):
            weight[container(path)] = weight.get(container(path), 0) + len(text) - linked
    if not weight:
        return sequence
    best = max(weight, key=lambda path: (weight[path], path))
    n = len(best)
    return [
        ((*best, "article", *path[n:]) if path[:n] == best and 2 * linked <= len(text) else path, text, linked)
        for path, text, linked in sequence
    ]


_path_vectors: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    known = _path_vectors.get(path)
    if known is None:
        if len(_path_vectors) > 20_000:  # a cache, not a limit on paths
            _path_vectors.clear()
        known = np.zeros(PATH_SIZE, np.float32)
        for depth, entry in enumerate(reversed(path)):
            known[zlib.crc32(entry.encode()) % PATH_SIZE] += 1.0
            if depth < 2:
                known[zlib.crc32(f"{depth}{entry}".encode()) % PATH_SIZE] += 0.5
        _path_vectors[path] = known
    return known


def features(sequence: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    """One row per block: path, words and sizes."""
    n = len(sequence)
    rows = np.zeros((n, PATH_SIZE + WORD_SIZE + SIZES), np.float32)
    if not n:
        return rows
    for i, (path, _, _) in enumerate(sequence):
        rows[i, :PATH_SIZE] = _path_vector(path)
    counts = np.zeros(n, np.int64)
    words = np.zeros((n, WORD_SIZE), np.float32)
    for piece in hashing.pieces(pa.array([text for _, text, _ in sequence], pa.large_string())):
        block = np.repeat(np.arange(len(piece.offsets) - 1), np.diff(piece.offsets))
        own = piece.first + np.arange(len(piece.offsets) - 1)
        cell = (piece.word_hashes(lower=True) % np.uint64(WORD_SIZE)).astype(np.int64)
        words[own] = np.bincount(block * WORD_SIZE + cell, minlength=len(own) * WORD_SIZE).reshape(-1, WORD_SIZE)
        counts[own] = np.diff(piece.offsets)
    rows[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = words / np.maximum(np.sqrt((words**2).sum(1, keepdims=True)), 1)
    length = np.array([len(text) for _, text, _ in sequence], np.float32)
    link = np.array([linked for _, _, linked in sequence], np.float32)
    rows[:, -SIZES:] = np.stack(
        [np.log1p(length) / 6, np.log1p(counts) / 4, np.minimum(link / length, 1), length / np.maximum(counts, 1) / 10, length < 25], 1
    )
    return rows


def new_network(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    wide = PATH_SIZE + WORD_SIZE + SIZES
    net = {"out": rng.normal(0, 0.1, 2 * HIDDEN), "out_bias": np.zeros(1)}
    for side in "fb":
        net[f"x{side}"] = rng.normal(0, wide**-0.5, (wide, 4 * HIDDEN))
        net[f"h{side}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        net[f"bias{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return {name: value.astype(np.float32) for name, value in net.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _read(net, side: str, inputs: np.ndarray, mask: np.ndarray, memory: list | None = None) -> np.ndarray:
    """Hidden states (time, page, HIDDEN) of one direction; padded steps keep the state as it is."""
    steps, pages, wide = inputs.shape
    gates = (inputs.reshape(-1, wide) @ net[f"x{side}"] + net[f"bias{side}"]).reshape(steps, pages, -1)
    h = c = np.zeros((pages, HIDDEN), np.float32)
    states = np.zeros((steps, pages, HIDDEN), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = gates[t] + h @ net[f"h{side}"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        live = mask[t][:, None]
        new_c = f * c + i * g
        squashed = np.tanh(new_c)
        if memory is not None:
            memory.append((t, h, c, i, f, o, g, squashed, live))
        h, c = np.where(live, o * squashed, h), np.where(live, new_c, c)
        states[t] = h
    return states


def probabilities(net, inputs: np.ndarray, mask: np.ndarray) -> np.ndarray:
    both = np.concatenate([_read(net, "f", inputs, mask), _read(net, "b", inputs, mask)], 2)
    return _sigmoid(both @ net["out"] + net["out_bias"][0])


def _gradients(net, inputs, mask, labels) -> dict[str, np.ndarray]:
    steps, pages, wide = inputs.shape
    memory = {"f": [], "b": []}
    both = np.concatenate([_read(net, side, inputs, mask, memory[side]) for side in "fb"], 2)
    error = (_sigmoid(both @ net["out"] + net["out_bias"][0]) - labels) * mask / max(1, mask.sum())
    grads = {"out": np.einsum("tp,tph->h", error, both), "out_bias": error.sum(keepdims=True).reshape(1)}
    for s, side in enumerate("fb"):
        above = error[:, :, None] * net["out"][s * HIDDEN : (s + 1) * HIDDEN]
        dh = dc = np.zeros((pages, HIDDEN), np.float32)
        dz_all = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
        d_recurrent = np.zeros_like(net[f"h{side}"])
        for t, h, c, i, f, o, g, squashed, live in reversed(memory[side]):
            dh = dh + above[t]
            inner = np.where(live, dc + dh * o * (1 - squashed**2), 0)
            dz = np.concatenate(
                [inner * g * i * (1 - i), inner * c * f * (1 - f), np.where(live, dh, 0) * squashed * o * (1 - o), inner * i * (1 - g**2)], 1
            )
            dz_all[t] = dz
            d_recurrent += h.T @ dz
            dc = np.where(live, inner * f, dc)
            dh = np.where(live, dz @ net[f"h{side}"].T, dh)
        grads[f"x{side}"] = inputs.reshape(-1, wide).T @ dz_all.reshape(-1, 4 * HIDDEN)
        grads[f"h{side}"] = d_recurrent
        grads[f"bias{side}"] = dz_all.sum((0, 1))
    return grads


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    inputs = np.zeros((lengths.max(initial=1), len(sequences), sequences[0].shape[1]), np.float32)
    for p, rows in enumerate(sequences):
        inputs[: len(rows), p] = rows
    return inputs, np.arange(len(inputs))[:, None] < lengths[None, :]


# Boilerplate and containers that altered training pages show.
_CONTAINERS = [("div", ".content"), ("div", ".post", ".body"), ("main",), ("section", ".entry"), ("div", ".main"), ("div",), ("article",), ("main", "article"), ()]
_BOILERPLATE = [
    ("nav", "ul", "li"), ("div", ".menu", "ul", "li"), ("header", "div"), ("header", "h1"), ("footer", "p"), ("footer", "ul", "li"), ("aside", "p"), ("aside", "div", "h3"),
    ("div", ".sidebar", "p"), ("div", ".sidebar", "ul", "li"), ("div", ".ad"), ("div", ".advert", "p"), ("div", ".ads", "banner"), ("form", "label"), ("form", "p"),
    ("div", ".cookie", ".notice", "p"), ("div", ".notice"), ("div", ".banner", "p"), ("section", ".comments", "div", ".comment", "p"), ("div", ".comment", "p"),
    ("ul", ".comments", "li", "p"), ("div", ".related", "ul", "li"), ("div", ".share"), ("div", ".newsletter", "p"), ("div", ".promo", "p"), ("div", ".social", "ul", "li"), ("button",),
]


def _altered(sequence, rng) -> tuple[list, list[int]]:
    """The page with another container around its article and boilerplate blocks in and around it."""
    container = _CONTAINERS[rng.integers(len(_CONTAINERS))]
    texts = [text for path, text, _ in sequence if text]
    out, labels = [], []

    def boilerplate(chance, prefix=("html", "body")):
        while rng.random() < chance:
            path = prefix + _BOILERPLATE[rng.integers(len(_BOILERPLATE))]
            words = texts[rng.integers(len(texts))].split(" ")
            start = rng.integers(len(words))
            text = " ".join(words[start : start + 1 + int(rng.exponential(12))])
            for _ in range(1 + int(rng.exponential(1.5)) if "li" in path or ".comment" in path else 1):
                out.append((path, text, len(text) if "li" in path and rng.random() < 0.7 else 0))
                labels.append(0)

    boilerplate(0.6)
    for path, text, linked in sequence:
        label = structural_label(path)
        if label:
            inner = path[max(i for i, e in enumerate(path) if e in ARTICLE_TAGS) + 1 :]
            path = ("html", "body", *container, *inner)
            boilerplate(0.05, ("html", "body", *container))
        out.append((path, text, linked))
        labels.append(label)
    boilerplate(0.6)
    return out, labels


def train(pages: list[str | None], *, epochs: int = 8, altered: int = 2, seed: int = 0, window: int = 64) -> dict[str, np.ndarray] | None:
    """Network trained on the given pages; None if no block is labelled as article."""
    rng = np.random.default_rng(seed)
    examples = []
    for page in pages:
        sequence = blocks(page)
        labels = [structural_label(path) for path, _, _ in sequence]
        shown = sequence
        if not any(labels):
            shown = marked_article(sequence)
            labels = [structural_label(path) for path, _, _ in shown]
        if not any(labels):
            continue
        for own, marks in [(sequence, labels), *[_altered(shown, rng) for _ in range(altered)]]:
            rows = features(own)
            for start in range(0, len(rows), window):
                examples.append((rows[start : start + window], np.array(marks[start : start + window], np.float32)))
    if not examples:
        return None
    net = new_network(seed)
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for start in range(0, len(order), 32):
            chosen = [examples[i] for i in order[start : start + 32]]
            inputs, mask = _padded([rows for rows, _ in chosen])
            labels, _ = _padded([marks[:, None] for _, marks in chosen])
            step += 1
            for name, grad in _gradients(net, inputs, mask, labels[:, :, 0]).items():
                grad = np.clip(grad, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.99 * second[name] + 0.01 * grad**2
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                net[name] = (net[name] - 0.01 * move).astype(np.float32)
    return net


def label_pages(net, sequences: list[list]) -> list[np.ndarray]:
    """Whether each block of each page is article; pages of similar length are read side by side."""
    if net is None:
        return [np.array([structural_label(path) for path, _, _ in s], bool) for s in sequences]
    result: list[np.ndarray] = [np.zeros(0, bool)] * len(sequences)
    order = sorted((i for i, s in enumerate(sequences) if s), key=lambda i: len(sequences[i]))
    at = 0
    while at < len(order):
        stop, cells = at, 0
        while stop < len(order) and stop - at < 128 and (stop == at or cells <= 20_000):
            stop += 1
            cells = (stop - at) * len(sequences[order[stop - 1]])
        chosen = order[at:stop]
        rows = features([block for i in chosen for block in sequences[i]])
        cuts = np.cumsum([len(sequences[i]) for i in chosen])[:-1]
        inputs, mask = _padded(np.split(rows, cuts))
        scores = probabilities(net, inputs, mask)
        for p, i in enumerate(chosen):
            result[i] = scores[: len(sequences[i]), p] >= 0.5
        at = stop
    return result


def extract(
    pages: DataFrame,
    *,
    id_column: str = "page_id",
    html: str = "html",
    url: str = "url",
    train_pages: int = 100,
    pages_at_once: int = 256,
) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    source = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    sample = source.where(F.col("html").isNotNull()).orderBy(F.xxhash64("url", "html"), "page_id").limit(train_pages)
    net = train([row.html for row in sample.select("html").collect()])
    shared = source.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, pages_at_once):
                some = batch.slice(start, pages_at_once)
                sequences = [blocks(page) for page in some.column("html").to_pylist()]
                texts = [
                    "\n".join(text for (_, text, _), yes in zip(sequence, labels) if yes)
                    for sequence, labels in zip(sequences, label_pages(shared.value, sequences))
                ]
                yield pa.RecordBatch.from_arrays(
                    [some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
