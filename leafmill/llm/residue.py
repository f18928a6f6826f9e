"""Problem 4: template residue, filler, error messages and script notices in place of content.

Two character n-gram models are fitted on labelled texts: one of filler and
notices against natural prose and page furniture, one of the shapes of unfilled
placeholders against the shapes of prose.  Log-likelihood ratios are summed
over windows (sentences and short lines, code left out).  Every window weighs
as much as it is likely to be the page's own matter, by the main-body model and
by its own ratio.  A page is a case if a placeholder window is confirmed, or if
residue windows cover most of that weight.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import furniture_texts, labelled, residue_texts
from .body import CLIP as SURE
from .body import Lines, model
from .common import by_blocks, strings
from .kernel import ALNUM, SPACE, Block, mix, spans_hash, tables

BUCKETS = 1 << 18
#: Weight of the shorter context in the n-gram models, in counts; ratios of single symbols are cut at CLIP.
BACK, CLIP = 20.0, 2.0
#: A window is residue if its ratio is this high in all and on average; a page if so much of its body is.
TOTAL, MEAN, COVERAGE = 2.0, 0.05, 0.5
#: Texts of each model's two classes (bounded, independent of the corpus).
TEXTS = 16_000
#: Labelled pages whose furniture is fitted as natural (bounded as well).
PAGES = 250
#: Mean characters of a page's own matter where it is residue and where it is content (exponential lengths).
LENGTHS = 80.0, 900.0
#: The most that a window's own ratio adds to its log-odds of being the page's own matter.
PULL = 6.0
# Natural sentences near the subject that are no cases.
NEAR = ["W answers 404 Not Found when the page does not exist.", "Pages that need JavaScript are opened in a headless browser.", "Designers fill a mock-up with lorem ipsum before the real text is ready.", "The error page tells readers what went wrong and where to look next.", "If the server is down for maintenance, the crawler waits and tries again later.", "A template replaces each placeholder with the value of the record.", "The log lists every request that timed out.", "Write the name of the variable where the value belongs.", "Each error has a code, and the table below explains it.", "The loader shows a short notice until the scripts have run.", "Der Server meldet einen Fehler, wenn die Seite nicht vorhanden ist.", "Le serveur signale une erreur quand la page manque.", "El servidor avisa de un error cuando falta la página.", "O servidor avisa de um erro quando falta a página."]
# Words of technical prose, for natural sentences of wide vocabulary.
WORDS = {
    "en": "the a each every this that some most older small large public local remote hidden stable broken daily recent pending optional temporary verbose internal narrow slow strict plain relative queue server client worker parser index table column record field header footer buffer cursor snapshot template filter heading paragraph chapter folder archive ledger export report schedule session profile token key version label message warning error limit rule route link image asset script task job row page entry file batch gateway adapter handler resolver selector converter connector channel pipeline registry manifest mapping digest bundle checkpoint replica shard viewport frontier crawler fetcher sitemap webhook footnote annotation bookmark credential permission quota dashboard workspace notebook reads writes keeps drops holds stores copies moves sorts merges splits counts checks tracks trims groups orders rejects accepts restores renames releases resumes pauses validates compresses forwards exposes collects rewrites resolves shares loads opens closes before after while when since because although until whenever once twice rarely quietly manually directly safely later again first only then nothing somebody nobody anyway fewer together choose use ask recommend remain suits needs comes sits means matters lost built tempting possible enough first run in small steps and reports that failed which were signed earlier order in which they behind second nobody has by hand yet both their".split(),
    "de": "der die das ein eine jeder viele alle danach sobald wenn ohne mit bevor obwohl server speicher ordner auftrag abruf vorgang zugriff absatz anhang bericht zeitplan eintrag filter index titel verlauf dienst knoten prozess crawler dateien zeilen regeln rechte fehler bilder seiten tabellen spalten kapitel verweise meldungen einträge grenzen schlüssel felder liest schreibt öffnet schließt kopiert prüft zählt sammelt sortiert kürzt teilt verwirft meldet verfolgt ersetzt bleibt offen erhalten direkt langsam später selten sicher immer weiteres mal leichter finden minuten sekunden versuche ob zeigt neben man sieht am welche nicht nur".split(),
    "fr": "le la les un une chaque ce quand sans avec dans pour si il suffit on voit serveur fichier dossier rapport journal registre module projet champ lien lot jeton contenu titre cache service script compte sommaire tampon pages lignes règles clés images tables notes tâches erreurs sections colonnes copies limites garde lit ouvre ferme copie trie vérifie combine remplace retire note ajoute change avant que soit vérifié copié fermé chargé après au bout de toujours souvent rarement lentement aussitôt directement restent en place car les autres seconde fois donner".split(),
    "es": "el la los las un cada ese cuando sin con en para si basta archivo servidor lote módulo esquema registro informe permiso recurso enlace filtro campo proceso proyecto mensaje capítulo documento plazo páginas líneas reglas claves imágenes tablas notas tareas secciones columnas rutas copias abre lee guarda copia ordena revisa combina cuenta cambia antes de que quede abierto al cabo intentos siguen ahí porque siempre apenas pronto despacio otra vez más fácil encontrar dar puede abrir ya fue las demás solo faltan".split(),
    "pt": "o a os as um cada esse quando sem com no para basta arquivo servidor lote módulo esquema registro relatório acesso recurso atalho filtro campo processo projeto bloco índice motor aviso prazo páginas linhas regras chaves imagens tabelas notas tarefas seções colunas rotas cópias abre lê guarda copia ordena revisa combina conta muda antes que seja verificado ao fim de continuam ali porque sempre logo raramente mais uma vez entregar fique as outras somente faltam".split(),
}
# Marks for a text still to be written.
MARKS = ["TBD", "TODO", "FIXME"]
_ID = r"[A-Za-z][\w.\-]*"
#: What confirms a placeholder window: each syntax of FORMS around an identifier.
CONFIRM = re.compile(
    rf"\{{\{{\{{?\s*[^{{}}\n]+\}}\}}|\{{%[^%\n]+%\}}|[$#]\{{\s*{_ID}\s*\}}|<%[=-]?[^%\n]+%>|\[%[^%\n]+%\]|\[\[\s*{_ID}\s*\]\]|\(\(\s*{_ID}\s*\)\)|%%{_ID}%%|@@{_ID}@@|(?<!\w)__[A-Za-z][A-Za-z0-9.\-]*(?:_[A-Za-z0-9.\-]+)*__(?!\w)|\${_ID}\$|\{{\s*{_ID}\s*\}}|%\({_ID}\)[sd]|<<\s*{_ID}\s*>>"
    rf"|&lt;\s*{_ID}\s*&gt;|<(?!/|br|hr|p\b|b\b|i\b|h[1-6]\b|em\b|strong|code|pre|a\b|img|div|span|ul|li|ol|table|t[rdh]\b|sup|sub|kbd|https?:|mailto:){_ID}>|\[[^\[\]\n]*\b(?:goes here|here)\]|\[(?:insert|your|enter|add)\b[^\[\]\n]+\]|(?-i:\b(?:TBD|TODO|FIXME)\b)",
    re.I,
)
_INLINE = re.compile(r"``[^`\n]+``|`[^`\n]+`")


def _shapes(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, place) of the runs of a block: white space, words, each of MARKS, and each other character by itself."""
    kind = np.where(b.has(SPACE), 0, np.where(b.has(ALNUM), 1, 2))
    v = np.where(kind == 0, np.uint64(1), np.where(kind == 1, np.uint64(2), b.lower.astype(np.uint64) + np.uint64(9)))
    change = np.ones(b.n, bool)
    change[1:] = (v[1:] != v[:-1]) | (kind[1:] == 2)
    at = np.flatnonzero(change)
    v = v[at]
    known = Block(MARKS)
    h = spans_hash(tables()[2][b.ix], at, np.append(at[1:], b.n))
    for k, mark in enumerate(spans_hash(tables()[2][known.ix], known.starts, known.ends)):
        v[h == mark] = np.uint64(3 + k)
    return mix(v), at


def _characters(b: Block) -> np.ndarray:
    """Symbol of each character: lower case, digits alike, white space alike but for line feeds."""
    v = b.lower_hash.copy()
    v[(b.lower >= 48) & (b.lower < 58)] = tables()[2][48]
    v[b.has(SPACE) & (b.cp != 10)] = tables()[2][32]
    return v


def _sums(v: np.ndarray, order: int):
    """Sums of the symbols of the n-grams that end at each symbol, for n = 1 to ``order``."""
    h = np.zeros(len(v), np.uint64)
    for k in range(order):
        h = h.copy()
        h[k:] += v[: len(v) - k] * np.uint64(2 * k * k + 3)
        yield h


def _buckets(h: np.ndarray, k: int) -> np.ndarray:
    return (mix(h + np.uint64(k)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _grams(v: np.ndarray, order: int):
    """Buckets of the n-grams that end at each symbol, for n = 1 to ``order``."""
    return (_buckets(h, k) for k, h in enumerate(_sums(v, order)))


class Ratios:
    """Log-likelihood ratio of each symbol after the symbols before it, under two n-gram models.

    The models are interpolated: an n-gram's probability is its count with
    ``BACK`` times the probability after a shorter context added.  ``tables``
    hold the ratio of every n-gram seen in either class; a symbol takes the one
    of its longest n-gram that was seen, none if even the shortest was not.
    """

    def __init__(self, bad: list[np.ndarray], good: list[np.ndarray], order: int):
        self.order = order
        self.tables = [np.full(BUCKETS, np.nan, np.float32) for _ in range(order)]
        seqs = [[list(_grams(v, order)) for v in part] for part in (bad, good)]
        grams = [[np.concatenate([g[k] for g in part]) for k in range(order)] for part in seqs]
        # the context of an n-gram is the (n-1)-gram that ends one symbol earlier
        before = [[np.concatenate([np.concatenate([[0], g[k - 1][:-1]]) for g in part]) if k else np.zeros(len(grams[c][0]), np.int64) for k in range(order)] for c, part in enumerate(seqs)]
        seen = [np.unique(np.concatenate([grams[0][k], grams[1][k]]), return_index=True) for k in range(order)]
        both = [np.concatenate([grams[0][k], grams[1][k]]) for k in range(order)]
        ctx = [np.concatenate([before[0][k], before[1][k]]) for k in range(order)]
        prob = [np.full(len(both[0]), 1 / 4000) for _ in range(2)]
        for k in range(order):
            for c in range(2):
                n = np.bincount(grams[c][k], minlength=BUCKETS)
                d = np.bincount(before[c][k], minlength=BUCKETS)
                prob[c] = (n[both[k]] + BACK * prob[c]) / (d[ctx[k]] + BACK)
            g, first = seen[k]
            self.tables[k][g] = np.clip(np.log(prob[0][first] / prob[1][first]), -CLIP, CLIP)

    def of(self, v: np.ndarray) -> np.ndarray:
        """The ratio of each symbol."""
        out = np.zeros(len(v), np.float32)
        left = np.arange(len(v))
        for k, h in reversed(list(enumerate(_sums(v, self.order)))):  # the longest n-gram first, shorter ones where it was not seen
            x = self.tables[k][_buckets(h[left], k)]
            none = np.isnan(x)
            out[left[~none]] = x[~none]
            left = left[none]
        return out


class Models:
    def __init__(self, text: Ratios, shape: Ratios):
        self.text, self.shape = text, shape


@functools.lru_cache(20)
def models(seed: int = 11, without: tuple[str, ...] = ()) -> Models:
    """Both ratio tables, fitted on labelled texts; ``without`` names kinds of residue that are left out of the fit."""
    r = random.Random(seed)
    mk = labelled._Maker(seed)
    bad = [residue_texts.text(r, without) for _ in range(TEXTS)]
    good = []
    for lang in furniture_texts.LANGUAGES:
        site = mk.word().capitalize()
        good += [mk.sentence(site, lang) for _ in range(900 if lang == "en" else 450)] + [mk.title(site, lang) for _ in range(90)]
    good += [mk.fill(p, "Halden", "en") for p in NEAR * 14]
    good += [line for p in labelled.pages(PAGES, seed) for line, own in p if own == 0]
    for lang, words in WORDS.items():
        good += [" ".join(r.choices(words, k=r.randint(8, 18))).capitalize() + "." for _ in range(400 if lang == "en" else 150)]
    good += [f"data:{mk.word()};base64," + "".join(r.choices("0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz+/", k=400)) for _ in range(60)]
    good += [f"data:{mk.word()};base64," + "".join(r.choices("0123456789abcdef", k=400)) for _ in range(60)]
    chars = lambda texts: [_characters(Block(texts))]
    runs = lambda texts: [_shapes(Block(texts))[0]]
    return Models(Ratios(chars(bad), chars(good), 5), Ratios(runs([residue_texts.placeholder(r) for _ in range(TEXTS // 4)]), runs(good), 3))


def _windows(b: Block, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, line) of the sentences of each line."""
    stop = np.isin(b.cp, [46, 33, 63, 0x3002, 0xFF01, 0xFF1F])
    stop[:-1] &= b.has(SPACE)[1:] | (b.cp[:-1] > 0x3000)
    cut = np.flatnonzero(stop) + 1
    lo, hi = np.searchsorted(cut, s, "right"), np.searchsorted(cut, e, "left")
    n = hi - lo + 1
    line = np.repeat(np.arange(len(s)), n)
    k = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    ws = np.where(k == 0, s[line], cut[np.minimum(lo[line] + k - 1, max(len(cut) - 1, 0))] if len(cut) else 0)
    we = np.where(k == n[line] - 1, e[line], cut[np.minimum(lo[line] + k, max(len(cut) - 1, 0))] if len(cut) else 0)
    return ws, we, line


def _cases(texts: list[str | None], body_model, m: Models, total: float, mean: float, coverage: float) -> np.ndarray:
    b = Block(texts)
    x = Lines(b)
    own = np.clip(body_model.score(x), -SURE, SURE)
    own[body_model.body(x)] = SURE  # lines of the best runs are the page's own matter
    own, s, e, page = own[~x.code], x.s[~x.code], x.e[~x.code], x.page[~x.code]
    flag = np.zeros(len(texts), bool)
    if not len(s):
        return flag
    # residue windows: sentences whose ratio is high in all and on average
    w = np.concatenate([[0.0], np.cumsum(m.text.of(_characters(b)), dtype=np.float64)])
    ws, we, line = _windows(b, s, e)
    size = np.maximum(we - ws, 0)
    ratio = w[np.maximum(we, ws)] - w[ws]
    table = (b.cp[s] == 124)[line]
    # how much likelier residue is than content for a page with so much matter of its own
    matter = np.bincount(page[line], size / (1 + np.exp(-own[line])), len(texts))
    few = np.clip(math.log(LENGTHS[1] / LENGTHS[0]) - matter * (1 / LENGTHS[0] - 1 / LENGTHS[1]), -SURE, SURE)
    res = (ratio > np.minimum(total, 0.6 * size) - np.maximum(few, 0)[page[line]]) & (ratio > mean * size * (few <= 0)[page[line]]) & ~table
    # placeholder windows: runs of shapes with a high ratio, and short residue that stands for a text still to be written
    v, at = _shapes(b)
    w = np.concatenate([[0.0], np.cumsum(m.shape.of(v), dtype=np.float64)])
    a, z = np.searchsorted(at, s), np.searchsorted(at, e)
    score = w[3:] - w[:-3] if len(w) > 3 else np.zeros(1)
    best = np.maximum.reduceat(np.append(score, -9.0), np.minimum(np.stack([a, np.maximum(z, a + 1)], 1).ravel(), len(score)))[::2]
    some = np.zeros(len(s), bool)
    some[line[res]] = True
    hint = np.flatnonzero(((best > 0.5) | some) & (own + np.maximum(best, some * 3.0) > 0))
    for p, v in zip(page[hint].tolist(), strings(b, s[hint], e[hint])):
        if not flag[p] and CONFIRM.search(_INLINE.sub(" ", v)):
            flag[p] = True
    # coverage: each window weighs its size times the probability that it is the page's own matter
    odds = own[line] + np.where(res, np.clip(ratio, 0, PULL), 0.0)
    heavy = size / (1 + np.exp(-odds))
    natural = (b.cp[s] == 35)[line] & ~res  # a natural title over residue does not make it content
    hit = np.bincount(page[line], np.where(res, heavy, 0), len(texts))
    solid = np.bincount(page[line], np.where(natural, 0, heavy), len(texts))
    # half of that will do where the page's own matter as a whole is likelier residue than prose
    whole = np.bincount(page[line], np.where(natural, 0, np.clip(ratio, -SURE * 5, SURE * 5) * (heavy / np.maximum(size, 1))), len(texts)) + few
    flag |= (hit > 0) & ((hit >= coverage * solid) | ((whole > 0) & (hit >= coverage / 2 * solid)))
    return flag


def found(pages: DataFrame, key: str = "page_id", text: str = "content", total: float = TOTAL, mean: float = MEAN, coverage: float = COVERAGE) -> DataFrame:
    """(key) of each page that shows residue, filler, an error or a script notice in place of content.

    Null, empty and blank texts are no cases, nor are pages of furniture only: no line
    is left out, but furniture weighs next to nothing.
    """
    bm, m, kind = model(), models(), pages.schema[key].dataType.simpleString()

    def work(texts, rows, _):
        at = np.flatnonzero(_cases(texts, bm, m, total, mean, coverage))
        yield pa.RecordBatch.from_arrays([rows.column(key).take(pa.array(at))], names=[key])

    return pages.select(key, text).mapInArrow(by_blocks(text, work), f"`{key}` {kind}")


def clean_pages(pages: DataFrame, key: str = "page_id", text: str = "content", **kw) -> DataFrame:
    """The rows of ``pages`` that are no cases, all columns kept; rows with a null key stay."""
    return pages.join(found(pages, key, text, **kw).where(f"`{key}` is not null").distinct(), key, "left_anti")
