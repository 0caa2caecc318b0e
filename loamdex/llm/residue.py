"""Template residue, filler and error-page text.

Method: a table of labelled residue exemplars (notices, filler, unfilled slots, outlines) is put into
one inverted index; each passage (sentence, line and two sentences in a row) is
looked up in it and scored by TF-IDF containment, that is the part of the exemplar's
weight found in the passage (of a vocabulary, the part of the passage's
weight found in it). A passage with high coverage marks the document; nothing else does.

Terms are words, pairs of words, pairs of characters where a script has no spaces, and shapes. A shape is a
stretch between brackets or like signs with its words folded to their letter case, so that one
exemplar ``{{ a.a }}`` covers every slot written that way; words that exemplars name stay as they are.

Document frequencies come from one pass over all documents; only the counts of the
exemplars' own terms (a bound fixed by the exemplar table) reach the driver. Lookup uses prefix
filtering: of each exemplar just the heaviest terms are indexed that every passage
with enough coverage must share, so no qualifying passage is missed.

Text inside code, pre, nowiki, math and like elements is quoted, not content, and is left out.

Defined results: null, empty and blank texts are no residue; repeated rows yield
their doc_id once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.6
SHORT = 4
VOCABULARY = 0.8

# Labelled exemplars, "_" standing for a word that varies.
PHRASES = """
you need to enable javascript to view this article
please enable javascript in your browser to continue
this page relies on scripts
this site requires javascript
switch them on in your browser settings and reload
your browser has scripting turned off so the encyclopedia cannot be displayed
scripts and cookies are required to continue
please wait while we check your browser
checking your browser before accessing
we use cookies accept all reject settings
accept all reject settings
content is hidden until a choice is made
please accept cookies to continue
sign in again
please sign in to view this page
please log in to continue
access denied your session expired before _ was delivered
too many requests from your network
wait _ seconds before asking for _ again
please try again later
please reload the page in a few minutes
page not found
404 page not found
403 forbidden
the page you requested could not be found
go back to the front page or use the search box
sorry nothing lives here any more
the address you followed to _ leads nowhere
this revision has been removed or never existed
return to the previous page
the requested view timed out
request timed out
connection to the article store was reset code
503 the upstream service did not answer in time
503 service unavailable
502 bad gateway
504 gateway timeout
500 internal server error
gateway problem we could not load this article
we could not load this article
the database cluster is locked for maintenance article text cannot be shown at present
article text cannot be shown at present
internal failure while rendering _
fatal allowed memory of _ mb exhausted in render step _
fatal error allowed memory size exhausted
expansion limit reached in template _ box the rest of this section is not shown
the rest of this section is not shown
template loop detected template _
script error the module _ does not exist
expression error unrecognised word _
lua error in module
something went wrong please try again
loading _ …
loading please wait …
bitte aktivieren sie javascript um diesen artikel zu lesen
interner fehler beim aufbau der seite
bitte später erneut versuchen
zeitüberschreitung die seite konnte nicht geladen werden
diese seite gibt es nicht mehr
zurück zur startseite
bitte warten sie einen moment
veuillez activer les scripts de votre navigateur pour afficher cet article
erreur interne le contenu n a pas pu être chargé
cette page n existe pas
la page demandée est introuvable
le contenu n a pas pu être chargé
para ver este artículo active los scripts en su navegador
se produjo un fallo del servidor vuelva a intentarlo más tarde
no se encontró la página solicitada
włącz obsługę skryptów aby zobaczyć tę stronę
błąd serwera
spróbuj ponownie za chwilę
nie znaleziono strony
чтобы увидеть статью включите скрипты в браузере
включите поддержку скриптов в браузере
ошибка сервера текст статьи временно недоступен
попробуйте ещё раз позже
страница не найдена
your text goes here
text goes here
blah blah blah more text to follow blah blah
more text to follow
sample paragraph
replace this text with your own words
section text coming soon
text coming soon
write the introduction here two or three sentences
to be written
hier steht später der text
texte à compléter
aquí va el texto
tu będzie tekst
здесь будет текст
lorem ipsum dolor sit amet
xx xx xxxx
this page requires cookies to be enabled
javascript is disabled in your browser
turn on javascript and reload the page
your browser does not support this feature please upgrade
verify that you are human
please complete the security check to continue
you must be logged in to view this content
your session has expired please sign in again
this content is available to subscribers only
service temporarily unavailable please try again in a few minutes
the server encountered an internal error and could not complete your request
bad request the server could not understand your request
the requested url was not found on this server
this page is temporarily unavailable
this site is under maintenance and will be back shortly
an unexpected error occurred while loading this page
an error has occurred please contact the administrator
failed to load the article please refresh
could not connect to the database
error establishing a database connection
you do not have permission to access this page
the page is loading please wait
you have been blocked for sending too many requests
uncaught exception in module
undefined index in line
insert your text here
type your text here
description goes here
content goes here
placeholder text
this is a placeholder please replace
this section will be written later
this page is under construction
bitte melden sie sich an um fortzufahren
bitte akzeptieren sie cookies um fortzufahren
seite nicht gefunden
die angeforderte seite wurde nicht gefunden
der server ist vorübergehend nicht erreichbar
zugriff verweigert
zu viele anfragen bitte warten
text folgt in kürze
platzhaltertext bitte ersetzen
veuillez accepter les cookies pour continuer
veuillez vous connecter pour continuer
veuillez patienter pendant la vérification
page non trouvée
erreur du serveur veuillez réessayer plus tard
accès refusé
trop de requêtes veuillez réessayer
votre texte ici
texte à venir
acepte las cookies para continuar
inicie sesión para continuar
espere mientras comprobamos su navegador
página no encontrada
error interno del servidor
acceso denegado
demasiadas solicitudes inténtelo más tarde
escriba aquí su texto
texto pendiente
zaakceptuj pliki cookie aby kontynuować
zaloguj się aby kontynuować
proszę czekać trwa sprawdzanie przeglądarki
strona nie została znaleziona
wewnętrzny błąd serwera
dostęp zabroniony
zbyt wiele żądań spróbuj później
wpisz tutaj tekst
примите файлы cookie чтобы продолжить
войдите чтобы продолжить
подождите идёт проверка браузера
внутренняя ошибка сервера
доступ запрещён
слишком много запросов повторите попытку позже
введите текст здесь
текст будет добавлен позже
abilita javascript nel browser per visualizzare questo articolo
pagina non trovata
errore interno del server
il testo va qui
ative o javascript no navegador para ver este artigo
página não encontrada
erro interno do servidor
o texto vai aqui
schakel javascript in om dit artikel te bekijken
pagina niet gevonden
interne serverfout
hier komt de tekst
ここに本文
本文を入力
本文が入ります
サーバーエラー
サーバエラー
ページは見つかりません
ページが見つかりません
javascriptを有効に
スクリプトを有効に
しばらくしてから
クッキーを有効に
ログインしてください
アクセスが拒否されました
少々お待ちください
メンテナンス中です
正文待补充
页面不存在
服务器错误
此处填写
请启用
请稍后再试
""".strip().split("\n")

# Words of filler prose.
FILLER = """lorem ipsum dolor amet consectetur adipiscing eiusmod tempor incididunt labore dolore magna aliqua
enim minim veniam nostrud ullamco laboris aliquip commodo consequat aute irure reprehenderit voluptate velit cillum fugiat nulla pariatur
situm omnis ipsum tandis fugit esto velut malora nullam quorum brevis pendo vela carta""".split()

# Unfilled slots and programming leftovers as shapes: a, A, W and 0 stand for words that begin small, in capitals, that
# begin with one and for numbers, x for any of the three, "…" for what may follow; longer words for themselves.
SLOTS = re.split(r"\s{2,}|\n", """
{{{x}}}  {{{x_x}}}  {{{x.x}}}  {{{x-x}}}  {{{x|}}}  {{{x_x|}}}  {{{x x}}}  {{{ x }}}  {{{ x_x }}}  {{{ x.x }}}  {{ a.a…
{{ a_a…  {{ a_a.a…  {{ a.a_a…  {%…%}  {%-…%}  {%-…-%}  [%…%]  {x}  {x_x}  {x.x}  {x.x_x}  {x_x.x}  {0}  ${x}  ${x_x}
${x.x}  ${x_x.x}  ${x.x_x}  $a$  $a_a$  $A$  $A_A$  $(x)  $(x_x)  {$x}  {$x_x}  {$x.x}  #{x}  #{x_x}  #{x.x}  ##A##
##A_A##  ###A###  %%x%%  %%x_x%%  %A%  %A_A%  %a%  %a_a%  %(a)s  %(a_a)s  @@x@@  @@x_x@@  @{x}  @{x_x}  @A@  @A_A@  __A__
__A_A__  ((a))  ((a_a))  «a»  «a_a»  *|A|*  *|A_A|*  *|A:A|*  <<x>>  <<x_x>>  <%…%>  <%=…%>  <%-…%>  <?=…?>  <?php…?>
<!--#…-->  <A A>  <x>  <x_x>  &lt;x&gt;  &lt;x_x&gt;  [A_A]  [SOURCE]  [HERE]  [A HERE]  [A_A HERE]  [A A HERE]  [TODO…]  [TBD…]
[FIXME…]  [INSERT…]  [Insert…]  [insert…]  [Your…]  [your…]  (your a here)  (your a a here)  [object Object]  NaN
""".strip())
# Words in brackets alone on a line (or paragraph) that stand for a part not written.
OUTLINE = "content references text introduction lead body history notes intro section image caption sources title".split() + ["body text", "see also"]

_QUOTED = re.compile(r"<(pre|code|nowiki|syntaxhighlight|source|math|tt|kbd|samp|blockquote)\b[^>]*>.*?</\1\s*>|```.*?```|(?m:^> .*$)", re.S | re.I)
_PARAM = re.compile(r"(?m)^\s*\|[^\n=|]*=\s*\{\{\{[^{}]*\}\}\}[ \t]*$")
# Behaviour switches of wiki pages and HTML elements, which aren't slots.
_SWITCH = {"TOC", "NOTOC", "FORCETOC", "NOINDEX", "INDEX", "NOEDITSECTION", "NEWSECTIONLINK", "NOGALLERY", "HIDDENCAT", "NOTITLECONVERT", "NOCONTENTCONVERT", "DISAMBIG", "STATICREDIRECT", "NONEWSECTIONLINK"}
_HTML = set("a abbr b big blockquote br caption center cite code col dd del div dl dt em font gallery h1 h2 h3 h4 h5 h6 hr i img imagemap includeonly ins kbd li math noinclude nowiki ol onlyinclude p poem pre q ref references s samp section small source span strike strong sub sup syntaxhighlight table tbody td th thead time timeline title tr tt u ul var head body html noscript script style template form input button label option select main nav header footer article aside figure figcaption iframe link meta video audio canvas svg path mi mo mn mrow msup msub mfrac".split())

_OUTLINE = re.compile(r"(?m)^[ \t]*(?:<p>)?[(\[]([^()\[\]\n]+)[)\]](?:</p>)?[ \t\r]*$")
_BLOCK = re.compile(r"(<[?%][=-]?|\{%-?|\[%-?|<!--#)((?:(?!\{%|\[%|<[?%]|<!--#)[^\n])+?)(-?[?%][>}\]]|-->)")
_WORDS = re.compile(r"[^\W_]+")
_HEAD = re.compile(r" ?[\w.]+")
_RUN = re.compile(r"([aAW0])([ ._-])\1(?:\2\1)+")
_TERM = re.compile(r"[^\W_]+|…")
_SOLID = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
_SPLIT = re.compile("[\u3040-\u30ff\u3400-\u9fff]+|[^\u3040-\u30ff\u3400-\u9fff]+")
_CUT = re.compile(r"(?<=[.!?…。])\s+|[\r\n]+|</?(?:p|div|h\d|body|title|head|html|noscript|strong|span|br|li)\b[^>]*>")


def _literals(shapes: list[str]) -> frozenset[str]:
    return frozenset(w for x in shapes for w in _WORDS.findall(x) if len(w) > 1)


_LITERAL = _literals(SLOTS)


def _folded(body: str, literal: frozenset[str] = frozenset()) -> str:
    def word(m):
        w = m[0]
        return w if w in literal else "0" if w.isdigit() else "a" if w[0].islower() else "A" if w.isupper() else "W"

    return _RUN.sub(r"\1\2\1", _WORDS.sub(word, body))


def slot_shapes() -> list[str]:
    """The exemplars' shapes, each x as each of its letter cases."""
    out = []
    for x in SLOTS:
        for case in "aAW" if re.search(r"(?<![^\W_])x(?![^\W_])", x) else "a":
            out.append(re.sub(r"(?<![^\W_])x(?![^\W_])", case, x))
    return out + [f"^({x})$" for x in OUTLINE]


def _chunks(shapes: list[str]) -> tuple[list[str], re.Pattern, re.Pattern]:
    """Opening signs followed by words and closing signs as far as they may be one of some shapes; words that are shapes themselves."""
    begins: dict[str, set[str]] = {}
    words = []
    for x in shapes:
        if re.fullmatch(r"\w+", x) and not x.startswith("_"):
            words.append(x)
        elif x[0] != "^" and (m := re.match(r"(&lt;|__|\W+?)( ?)([^\W_]+)", x)):
            first = {"a": "[^\\W\\d_A-Z]", "A": "[^\\W\\d_a-z]", "W": "[^\\W\\d_a-z]", "0": "[0-9]"}.get(m[3], re.escape(m[3]))
            begins.setdefault(m[1], set()).add(m[2] + first)
    signs = "|".join(f"{re.escape(o)}(?={'|'.join(sorted(b))})" for o, b in sorted(begins.items(), reverse=True))
    return words, re.compile(rf"({signs})(?=([^\n{{}}<>\[\]()%$#@*«»&]+?)(&gt;|\)s\b|[}}\]>)%$@*|»#]+|__(?!_)))"), re.compile(rf"\b(?:{'|'.join(words)})\b")


_ODD, _CHUNK, _WORD_SHAPE = _chunks(slot_shapes())
_OPENING = frozenset("{<[(%$#@*|«_")


def shapes(text: str) -> set[str]:
    """Shapes in a text: each whole, without its inside, and by its head; in ``^`` and ``$`` what is all of a line."""
    out = set(_WORD_SHAPE.findall(text)) if any(w in text for w in _ODD) else set()
    if "<" in text or "%" in text:
        for m in _BLOCK.finditer(text):
            head = _WORDS.match(m[2])
            out |= {f"{m[1]}…{m[3]}", f"{m[1]}{head[0] if head else ''}…{m[3]}"}
    for m in _CHUNK.finditer(text):
        opened, body, closed = m.groups()
        if m.start() and text[m.start() - 1] in _OPENING or opened == "__" and body in _SWITCH or opened in ("<", "&lt;") and body.strip().lower() in _HTML:
            continue
        for folded in {_folded(body), _folded(body, _LITERAL)}:
            out.add(opened + folded + closed)
            if head := _HEAD.match(folded):
                out |= {f"{opened}{head[0]}…", f"{opened}{head[0].split(' ')[0]}…{closed}"}
    for m in _OUTLINE.finditer(text) if "(" in text or "[" in text else ():
        out.add(f"^({m[1].strip().lower()})$")
    return out


def shown(text: str) -> str:
    """A text without what it quotes and without parameters of templates that are handed on."""
    if "<" in text or "```" in text or "> " in text:
        text = _QUOTED.sub(" ", text)
    if "{{{" in text:
        text = _PARAM.sub("", text)
    return text


_APART = {n: " " for n in range(128) if not chr(n).isalnum() and n}


def terms(passage: str) -> list[str]:
    low = passage.lower()
    if low.isascii():
        return low.translate(_APART).split()
    found = _TERM.findall(low)
    if not _SOLID.search(low):
        return found
    out = []
    for w in found:
        for part in _SPLIT.findall(w):
            out += [part[k : k + 2] for k in range(len(part) - 1)] if len(part) > 1 and _SOLID.match(part) else [part]
    return out


def passages(text: str):
    """Sentences and lines, and each two of them in a row."""
    before: list[str] = []
    for s in _CUT.split(text):
        if s and (t := terms(s)):
            yield t
            if before:
                yield before + t
            before = t


def _grams(t: list[str]) -> set[str]:
    return {*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))}


class Exemplars:
    """Inverted index of exemplars: term -> exemplars that can't reach the coverage without one of their indexed terms."""

    def __init__(self, phrases: list[str] = PHRASES, filler: list[str] = FILLER, coverage: float = COVERAGE):
        split = [[t for w in p.split() for t in ([w] if w == "_" else terms(w))] for p in phrases]
        # Short phrases are ordinary words in another order, so all of them must be there, in order; a shape is there or not.
        self.part = [1.0 if len(t) <= SHORT else coverage for t in split]
        self.grams = [frozenset(g for g in _grams(t) if "_" not in g.split()) for t in split]
        for x in slot_shapes():
            self.part.append(1.0)
            self.grams.append(frozenset([x]))
        self.vocabulary = len(self.grams)  # the last exemplar, of which a passage is to be a part
        self.part.append(VOCABULARY)
        self.grams.append(frozenset(filler))
        self.vocab = frozenset(w for g in self.grams for x in g for w in (x, *x.split()))

    def weigh(self, df: dict[str, int], n: int) -> Exemplars:
        idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 0.5))
        self.weight = {g: idf(g) if len(s) == 1 else sum(idf(w) for w in g.split()) / (1 + g.count(" ")) for s in self.grams for g in s}
        self.other = idf("")
        self.total = [sum(self.weight[g] for g in s) for s in self.grams]
        self.index = defaultdict(list)
        for k, s in enumerate(self.grams):
            if k == self.vocabulary or len(s) == 1:
                for w in s:
                    self.index[w].append(k)
                continue
            spare = (1 - self.part[k]) * self.total[k]
            # By falling weight of words, until what is not indexed can't make up the coverage: all grams of a word go with it.
            left = set(s)
            for w in sorted({w for g in s for w in g.split()}, key=lambda w: (-idf(w), w)):
                self.index[w].append(k)
                left = {g for g in left if w not in g.split()}
                if sum(self.weight[g] for g in s - left) > spare + 1e-6:
                    break
        self.anchors = frozenset(self.index)
        return self

    def touches(self, found: list[str] | set[str]) -> bool:
        return not self.anchors.isdisjoint(found)

    def coverage(self, k: int, t: list[str], grams: set[str]) -> float:
        """TF-IDF containment of exemplar ``k`` in a passage; of the vocabulary, of the passage in it."""
        if k != self.vocabulary:
            return sum(self.weight[g] for g in self.grams[k] & grams) / self.total[k]
        own = self.grams[k]
        if len(t) <= SHORT or len(own.intersection(t)) < SHORT:
            return 0.0
        inside = sum(self.weight[w] for w in t if w in own)
        return inside / (inside + sum(self.other for w in t if w not in own))

    def matches(self, t: list[str]) -> bool:
        grams = None
        for k in {k for w in set(t) for k in self.index.get(w, ())}:
            grams = grams or _grams(t)
            if self.coverage(k, t, grams) >= self.part[k] - 1e-9:
                return True
        return False


def is_residue(text: str, index: Exemplars) -> bool:
    text = shown(text)
    found = shapes(text)
    if index.touches(found) and index.matches([x for x in found if x in index.anchors]):
        return True
    return index.touches(terms(text)) and any(index.matches(t) for t in passages(text))


def _counts(docs: DataFrame, vocab: frozenset[str]) -> tuple[dict[str, int], int]:
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        count: Counter = Counter()
        n = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                t = shown(t)
                count.update(shared.value.intersection(terms(t)))
                count.update(shared.value & shapes(t))
                n += 1
        rows = [*count.items(), ("", n)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([c for _, c in rows], pa.int64())], names=["term", "n"])

    got = {r.term: r.n for r in docs.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return got, got.pop("", 0)


def residue(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE, phrases: list[str] = PHRASES, filler: list[str] = FILLER) -> DataFrame:
    """One row (doc_id) for each document with a passage covered by a residue exemplar."""
    import pyarrow as pa

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("length(text) > 0")
    index = Exemplars(phrases, filler, coverage)
    df, n = _counts(docs.select("text"), index.vocab)
    shared = documents.sparkSession.sparkContext.broadcast(index.weigh(df, n))

    def run(batches):
        ix = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([d for d, t in zip(ids, batch.column(1).to_pylist()) if is_residue(t, ix)], pa.int64())], names=["doc_id"])

    return docs.mapInArrow(run, "doc_id long").distinct()
