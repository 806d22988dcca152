"""Main text of web pages by a tree-structured graphical model.

Every block element, and every element within a line that is named like a part of a page, is
a binary variable, content or not. Its features give a unary
potential, and a potential for each pair of parent and child (by kind of child) ties
the tree together. Sum-product messages go from the leaves to the root and back, level
by level for all pages of a batch at once, and give each element's exact marginal. The
weights maximise the likelihood of labelled pages, whose gradient the same messages
yield. The labelled pages are generated from a seed (pagegen), so training takes no
input, its cost is fixed, and every worker gets the same weights by broadcast.

Text whose element has a marginal above one half is kept, in page order: character
references decoded, white space inside a block one space, blocks joined by one space.

Defined results: null, empty and text-less pages give the empty text; pages of any size
or depth are read whole, broken markup included; repeated rows give the same text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.llm.common import sparing, text_pieces
from plotwright.llm.dom import Tree, name_words, parse
from plotwright.llm.pagegen import labelled_pages

# Words in names (class, id, role) that tell what a part of a page is.
HINTS = {
    "nav": {*"nav menu navbar navigation breadcrumb breadcrumbs topnav subnav pagination pager toc tabs skip navi hauptmenu menue menus navegacion navigazione".split()},
    "head": {*"header masthead topbar branding logo head kopf kopfzeile encabezado entete intestazione".split()},
    "foot": {*"footer colophon copyright bottom foot contentinfo legal imprint fuss fusszeile impressum pied pie".split()},
    "side": {*"sidebar side widget widgets rail secondary complementary aside seitenleiste lateral laterale".split()},
    "ad": {*"ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted adbox adsense banner dfp werbung anzeige anzeigen reklame publicite pub publicidad anuncio anuncios pubblicita annonce annonces".split()},
    "notice": {*"notice cookie cookies consent gdpr alert alertdialog popup modal dialog overlay privacy disclaimer warning message toast hinweis aviso avis avviso".split()},
    "form": {*"newsletter subscribe subscription signup register search login form contact suche anmeldung abonnieren recherche buscar suscripcion".split()},
    "comments": {*"comment comments commentlist disqus responses replies reply respond discussion feedback guestbook thread kommentar kommentare commentaire commentaires comentario comentarios commento commenti reactie reacties".split()},
    "share": {*"share sharing social addthis follow teilen partager compartir".split()},
    "related": {*"related recommended recommendation recommendations more trending popular also outbrain taboola teaser verwandt aehnliche weitere aussi relacionados relacionadas correlati".split()},
    "hidden": {*"hidden invisible offscreen print noprint sr".split()},
    "body": {*"content article post entry story main body text prose page blog".split()},
}
#: Names that make an element within a line a node of its own.
PARTS = frozenset(w for kind in ("ad", "notice", "comments", "share", "related", "hidden") for w in HINTS[kind])
# What the headings of such parts say, in some languages.
HEADINGS = {
    "comments": ["comments", "comment", "reader comments", "responses", "replies", "leave a comment", "leave a reply", "join the discussion", "discussion", "kommentare", "kommentar", "leserkommentare", "kommentar schreiben", "commentaires", "commentaire", "laisser un commentaire", "comentarios", "comentario", "deja un comentario", "commenti", "reacties"],
    "related": ["related", "related stories", "related articles", "related posts", "related links", "see also", "read more", "read next", "more stories", "more articles", "more from", "more on this", "you may also like", "you might also like", "recommended", "recommended for you", "most read", "most popular", "trending", "popular posts", "further reading", "ähnliche artikel", "ähnliche beiträge", "weitere artikel", "mehr zum thema", "auch interessant", "das könnte sie auch interessieren", "lesen sie auch", "meistgelesen", "à lire aussi", "lire aussi", "voir aussi", "articles liés", "sur le même sujet", "les plus lus", "artículos relacionados", "relacionados", "noticias relacionadas", "te puede interesar", "lea también", "más leídas", "ver también", "leggi anche", "lees ook"],
    "ad": ["advertisement", "advertisements", "advert", "sponsored", "sponsored content", "promoted", "anzeige", "anzeigen", "werbung", "publicité", "annonce", "publicidad", "anuncio", "pubblicità"],
    "form": ["newsletter", "subscribe", "subscribe now", "sign up", "sign up for our newsletter", "log in", "login", "newsletter abonnieren", "anmelden", "jetzt anmelden", "abonnez vous", "inscrivez vous", "suscríbete", "suscribirse", "boletín"],
    "share": ["share", "share this", "share this article", "follow us", "teilen", "artikel teilen", "folgen sie uns", "partager", "partagez", "suivez nous", "compartir", "comparte", "síguenos"],
}
SAYS = {phrase: k for k, phrases in enumerate(HEADINGS.values()) for phrase in phrases}
N_HEADINGS = len(HEADINGS)
NO_LETTERS = re.compile(r"[\W\d_]+")
TITLES = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: The longest text that can be such a heading.
SHORT = 48
# Elements by what they say about their text.
TAGS = [["#root"], ["html"], ["head"], ["body"], ["article"], ["main"], ["section"], ["div"], ["p"], ["h1"], ["h2", "h3", "h4", "h5", "h6", "hgroup"], ["li", "dt", "dd"], ["ul", "ol", "dl", "dir"], ["nav", "menu"], ["header"], ["footer"], ["aside"], ["form", "fieldset", "legend", "select", "option", "optgroup", "button", "dialog", "search"], ["blockquote", "pre", "figure", "figcaption", "details", "summary", "caption"], ["table", "thead", "tbody", "tfoot", "tr", "td", "th"], ["address", "center", "frameset"]]
TAG_AT = {t: k for k, some in enumerate(TAGS) for t in some}
HINT_AT = {w: k for k, words in enumerate(HINTS.values()) for w in words}
LENGTHS = [1, 15, 40, 80, 160, 400]
N_TAGS, N_HINTS = len(TAGS), len(HINTS)
#: Where the features of headings begin: a heading that names a part, what stands under such a heading, a block that begins with one.
AT_HEADINGS = 1 + N_TAGS + N_HINTS + len(LENGTHS) + 1 + 4
#: bias, tag, hints, own length, share of links by bucket, headings, a cell of links alone, an article or main that no name says otherwise of, copyright sign
FEATURES = AT_HEADINGS + 3 * N_HEADINGS + 1 + 1 + 1
KINDS = 4


def says(tree: Tree) -> dict[int, int]:
    """What part each node's own text names, for short ones; a title may say more than a name of two or more words."""
    texts: dict[int, str] = {}
    for node, text in tree.pieces:
        if node >= 0 and tree.chars[node] <= SHORT and not text.isspace():
            texts[node] = f"{texts[node]} {text}" if node in texts else text
    out = {}
    for node, text in texts.items():
        words = NO_LETTERS.sub(" ", text.lower()).strip()
        found = SAYS.get(words)
        if found is None and tree.tags[node] in TITLES and " " in words:
            parts = words.split()
            found = next((SAYS[p] for n in range(len(parts) - 1, 1, -1) for p in (" ".join(parts[:n]), " ".join(parts[-n:])) if p in SAYS), None)
        if found is not None:
            out[node] = found
    return out


def headed(tree: Tree) -> list[tuple[int, int]]:
    """(node, feature) of what headings say: of themselves, of the siblings up to the next heading, and of a block that begins with one."""
    named = says(tree)
    out, under, begun = [], {}, set()
    for k in range(1, len(tree.tags)):
        p = tree.parents[k]
        title = tree.tags[k] in TITLES
        if k in named and (title or tree.tags[k] not in ("li", "td", "button", "option")):
            out.append((k, AT_HEADINGS + named[k]))
            if p not in begun and not tree.chars[p] and tree.tags[p] not in ("#root", "html", "body", "article", "main", "td"):
                out.append((p, AT_HEADINGS + 2 * N_HEADINGS + named[k]))
            under[p] = named[k] if title or tree.tags[k] in ("p", "div", "header", "dt", "strong") else under.get(p)
        elif title:
            under[p] = None
        elif (kind := under.get(p)) is not None:
            out.append((k, AT_HEADINGS + N_HEADINGS + kind))
        if tree.chars[k] or tree.tags[k] in TITLES:
            begun.add(p)
    return out


def describe(tree: Tree) -> tuple[list[list[int]], list[int]]:
    """Of each node the features that hold, and its kind: neutral, element that names a part of a page, so named, or a division of the page itself."""
    n = len(tree.tags)
    below, linked = tree.chars.copy(), tree.linked.copy()
    for k in range(n - 1, 0, -1):
        below[tree.parents[k]] += below[k]
        linked[tree.parents[k]] += linked[k]
    rights = {node for node, text in tree.pieces if "©" in text}
    headings: dict[int, list[int]] = {}
    for node, feature in headed(tree):
        headings.setdefault(node, []).append(feature)
    out, kinds = [], []
    for k, (tag, attributes) in enumerate(zip(tree.tags, tree.attributes, strict=True)):
        some = [0, 1 + TAG_AT.get(tag, TAG_AT["div"])]
        hints: set[int] = set()
        if attributes:
            for name in ("class", "id", "role", "itemprop"):
                if (value := attributes.get(name)) is not None:
                    hints.update(HINT_AT[w] for w in name_words(value) if w in HINT_AT)
            if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
                hints.add(HINT_AT["hidden"])
            some += [1 + N_TAGS + h for h in hints]
        own = tree.chars[k]
        if not own and not hints and k not in headings and tag in ("div", "section", "center"):
            some = []  # a bare wrapper says nothing of its own: its parent and children do
        else:
            some.append(1 + N_TAGS + N_HINTS + sum(own >= x for x in LENGTHS))
        share = linked[k] / below[k] if below[k] else 0.0
        if below[k]:
            some.append(1 + N_TAGS + N_HINTS + len(LENGTHS) + 1 + (0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3))
        if tag in ("td", "th") and share == 1:
            some.append(FEATURES - 3)
        if tag in ("article", "main") and not hints - {HINT_AT["content"]}:
            some.append(FEATURES - 2)
        if k in rights:
            some.append(FEATURES - 1)
        some += headings.get(k, [])
        out.append(some)
        kinds.append(2 if hints else 3 if tree.parents[k] >= 0 and tree.tags[tree.parents[k]] in ("#root", "html", "body") and tag in ("div", "section", "center", "ul") else 1 if tag in ("nav", "menu", "header", "footer", "aside", "form", "button", "dialog", "head", "article", "main", "select") else 0)
    return out, kinds


@dataclass
class Forest:
    """Nodes of many pages sorted by depth; levels: bounds of the depths; at: place of each node as it came."""

    features: np.ndarray
    owners: np.ndarray
    kinds: np.ndarray
    parents: np.ndarray
    levels: list[tuple[int, int]]
    at: np.ndarray


def forest(trees: list[Tree]) -> Forest:
    depths = np.concatenate([np.array(t.depths) for t in trees])
    order = np.argsort(depths, kind="stable")
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    features, owners, kinds, parents, base = [], [], [], [], 0
    for t in trees:
        some, kind = describe(t)
        for k, x in enumerate(some):
            features += x
            owners += [base + k] * len(x)
        kinds += kind
        parents += [p + base for p in t.parents]
        base += len(kind)
    parent = np.array(parents)[order]
    parent[depths[order] > 0] = at[parent[depths[order] > 0]]
    bounds = np.searchsorted(depths[order], np.arange(depths.max() + 2))
    return Forest(np.array(features), at[np.array(owners)], np.array(kinds)[order], parent, list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), at)


def messages(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of content by node, marginals of parent and child by node): sum-product, upward then downward.

    pair: log potentials by kind, parent's state and child's state.
    """
    n = len(f.kinds)
    up, sent, down = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2))
    np.add.at(up[:, 1], f.owners, unary[f.features])
    for a, b in reversed(f.levels[1:]):
        sent[a:b] = np.logaddexp.reduce(up[a:b, None, :] + pair[f.kinds[a:b]], axis=2)
        np.add.at(up, f.parents[a:b], sent[a:b])
    edges = np.zeros((n, 2, 2))
    for a, b in f.levels[1:]:
        p = f.parents[a:b]
        rest = up[p] + down[p] - sent[a:b]
        joint = rest[:, :, None] + pair[f.kinds[a:b]]
        down[a:b] = np.logaddexp.reduce(joint, axis=1)
        edges[a:b] = joint + up[a:b, None, :]
    belief = up + down
    inner = edges[f.levels[0][1] :]
    inner -= inner.max(axis=(1, 2), keepdims=True)
    np.exp(inner, out=inner)
    inner /= inner.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), edges


@functools.cache
def trained(pages: int = 1000, seed: int = 11, rounds: int = 200, rate: float = 0.1, decay: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """(unary weights, pair potentials) of greatest likelihood for the labelled pages, by gradient ascent with moments."""
    trees = [parse(p, PARTS) for p in labelled_pages(pages, seed)]
    f = forest(trees)
    y = np.concatenate([np.array([int(a.get("data-y", "1")) for a in t.attributes]) for t in trees])
    truth = np.empty(len(y), np.int64)
    truth[f.at] = y
    top = f.levels[0][1]
    seen_pair = np.zeros((KINDS, 2, 2))
    np.add.at(seen_pair, (f.kinds[top:], truth[f.parents[top:]], truth[top:]), 1)
    seen = np.bincount(f.features, weights=truth[f.owners].astype(float), minlength=FEATURES)
    x = np.zeros(FEATURES + KINDS * 4)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        marginal, edges = messages(f, x[:FEATURES], x[FEATURES:].reshape(KINDS, 2, 2))
        pair = np.zeros((KINDS, 2, 2))
        np.add.at(pair, f.kinds[top:], edges[top:])
        g = np.concatenate([seen - np.bincount(f.features, weights=marginal[f.owners], minlength=FEATURES), (seen_pair - pair).ravel()]) / pages - decay * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return x[:FEATURES], x[FEATURES:].reshape(KINDS, 2, 2)


def main_texts(pages: list[str], unary: np.ndarray, pair: np.ndarray) -> list[str]:
    if not pages:
        return []
    trees = [parse(p, PARTS) for p in pages]
    f = forest(trees)
    marginal = messages(f, unary, pair)[0][f.at]
    out, base = [], 0
    for t in trees:
        kept = (marginal[base : base + len(t.tags)] > 0.5).tolist()
        base += len(t.tags)
        kept.append(True)  # the edges of blocks, node -1
        out.append(" ".join("".join([text for node, text in t.pieces if kept[node]]).split()))
    return out


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chars: int = 400_000) -> DataFrame:
    """(id, url, text, n_chars) for every row; ``chars``: of markup in a batch, a longer page stands alone."""
    shared = df.sparkSession.sparkContext.broadcast(trained())
    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, pages in text_pieces(batch, "html", chars):
                texts = main_texts(pages, *shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(begin, len(pages)), batch.column("url").slice(begin, len(pages)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return picked.mapInArrow(sparing(run), "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
