"""Functions paired with what their documentation says.

A signature is parsed into a function node with its modifiers, type, name and parameters, a comment into a tree of a description and block tags with
inline tags and sentences inside. Visiting both, only words are kept that the names around the function do not say already.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many words that no name says make a description; of Chinese or Japanese characters, so many make a word.
WORDS_SAID, CHARACTERS_OF_A_WORD = 2, 2

#: Words that carry no meaning of their own in a comment.
EMPTY_WORDS = frozenset(
    "a an the this that these those it its of to in on at by for from with and or as is are be was were will if when whether then than into any all some each no not do does has have "
    "given specified provided passed respective corresponding appropriate current new own simple default value values object objects instance instances class classes method methods function functions "
    "constructor constructors field fields parameter parameters param params argument arguments arg args type types result results name names property properties attribute attributes variable member "
    "get gets getter getting set sets setter setting return returns returned returning create creates created creating construct constructs constructed build builds make makes init initialize initializes "
    "initialise initialises initialized call calls called invoke invokes execute executes perform performs performed handle handles process processes implement implements implementation override overrides "
    "default-constructor ctor konstruktor constructeur constructor конструктор instantiate instantiates instantiated accessor mutator wrapper helper test tests use uses used using throw throws thrown exception void null true false boolean int integer long string double float byte bytes char list map java util lang io "
    "see also above below here there thing things stuff something describes description documentation document javadoc doc comment standard usual basic main general "
    "der die das den dem des ein eine einen einer und oder von zu im in gibt zurück setzt liefert erzeugt neue neuen neues wert ist für "
    "el la los las un una de del y o devuelve obtiene establece crea nuevo nueva valor es para "
    "и в на с возвращает устанавливает создаёт создает новый значение это для "
    "le les des du et ou retourne renvoie définit crée nouveau nouvelle valeur est pour".split()
)
#: Block tags whose text tells something; all others hold references, versions or names of people.
TELLING_TAGS = frozenset("param return returns throws exception deprecated apiNote implNote implSpec note value description summary serial serialData warning usage".split())
#: Phrases of generators, of placeholders and of inheritance.
_EMPTY_NOTE = re.compile(
    r"\(non-javadoc\)|do\s+not\s+(?:edit|modify)|\b(?:was|is|been)\s+(?:auto(?:matically)?[- ]?)?generated\b|auto-?\s?generated|generated\s+(?:code|by|from|file|method|stub|javadoc)|<generated>|begin-user-doc|end-user-doc|\b(?:todo|fixme|xxx|tbd|hack)\b|not\s+(?:yet\s+)?(?:documented|implemented)|"
    r"\bno\s+(?:documentation|description|comment|javadoc)|(?:add|write|insert|missing|needs?)\s+(?:a\s+|the\s+|some\s+)?(?:description|documentation|javadoc|doc|docs|comment)s?\b|"
    r"(?:description|documentation|javadoc|comment)\s+(?:here|missing|needed|pending|goes)|lorem\s+ipsum|\bplaceholder\b|\btext\s+follows\b|\bto\s+(?:be|do)\s+(?:done|defined|determined|documented|completed|written|filled|described)\b|\bcoming\s+soon\b|^\W*(?:none|nothing|empty|unknown|undocumented)\W*$|"
    r"noch\s+zu\s+\w+ieren|\b(?:kommentar|beschreibung|dokumentation)\s+(?:fehlt|folgt|ergänzen)|\b(?:por|pendiente\s+de)\s+(?:documentar|hacer|completar|definir)|\bsin\s+(?:descripción|documentar|comentarios?)|à\s+(?:compléter|documenter|faire)|"
    r"(?:нужно|надо)\s+\w+|описание\s+(?:отсутствует|позже)|(?:без|нет)\s+описания|(?:допи|опи)сать\s+позже|待补充|待完善|待定|未完成|暂无|无说明|自动生成|未記入|説明なし|自動生成|"
    r"@inheritdoc|@generated|inherited\s+(?:doc|javadoc)|^\s*(?:see|cf\.?)\s+(?:above|below|super|parent)\b|\bn/?a\b\s*$|^\s*(?:\.{2,}|\?+|-+)\s*$",
    re.I)
_MACHINE = re.compile(r"generated\s+(?:by|from)\b|do\s+not\s+(?:edit|modify)", re.I)
_CODE = re.compile(
    r";\s*$|[{}]|^\s*//|^\s*(?:if|for|while|switch|catch|synchronized)\s*\(|^\s*(?:return|throw|import|package|final|private|public|protected|static|var|new)\b[^.]*[;(]|^\s*[\w.$]+\s*=[^=]|^\s*[\w$]+(?:\.[\w$]+)+\([^)]*\)\s*;?\s*$|^\s*@\w+(?:\(.*\))?\s*$|=>|->|&&|\|\|")
_INLINE = re.compile(r"\{@(\w+)\s*([^{}]*)\}")
_MARK = re.compile(r"^\s*(?:/\*+|\*+/|\*+|///?|#+|--)?[ \t]?|\s*\*+/\s*$")
_HTML = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_TAG = re.compile(r"^\s*[@\\](\w+)\b\s*(.*)$", re.S)
_CAMEL = regex.compile(r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?[\p{Ll}\p{M}]+|\p{Lu}+|[\p{Lo}\p{M}]+|\p{N}+")
_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_$.]*[\p{L}\p{N}]")
_NAME = regex.compile(r"[\p{L}_$]")
_TOKEN = regex.compile(r"[\p{L}_$][\p{L}\p{M}\p{N}_$]*(?:\.[\p{L}_$][\p{L}\p{M}\p{N}_$]*)*|\.\.\.|\"[^\"]*\"|\S")
_MODIFIERS = frozenset("public private protected static final abstract synchronized native default strictfp sealed".split())
_SENTENCE = regex.compile(r"(?<=[.!?。！？;])\s+|(?<=[。！？])")


@dataclass
class Function:
    """A function node: what its signature and its id say."""

    name: str
    owner: str
    modifiers: list[str] = field(default_factory=list)
    result: str = ""
    parameters: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Comment:
    """A comment: its sentences and its block tags, each a name, what it is about and sentences."""

    description: list[str]
    tags: list[tuple[str, str, list[str]]]


@dataclass
class Type:
    """A type node: its name and, inside its brackets, its arguments."""

    name: str
    arguments: list[Type] = field(default_factory=list)


class _Reader:
    """Reads a signature from left to right, one rule for each kind of node; what it can't read ends the rule and raises nothing."""

    def __init__(self, signature: str):
        self.tokens, self.at = _TOKEN.findall(signature), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        token = self.peek()
        self.at += 1
        return token

    def accept(self, *tokens: str) -> bool:
        if self.peek() in tokens and self.at < len(self.tokens):
            self.at += 1
            return True
        return False

    def named(self) -> bool:
        return bool(_NAME.match(self.peek()))

    def modifiers(self) -> list[str]:
        """Key words and annotations, whose arguments are passed over."""
        out = []
        while self.peek() in _MODIFIERS or self.peek() == "@":
            if not self.accept("@"):
                out.append(self.take())
                continue
            out.append("@" + self.take())
            depth = 0
            while self.peek() and (self.peek() == "(" or depth):
                token = self.take()
                depth += (token == "(") - (token == ")")
        return out

    def arguments(self) -> list[Type]:
        """What stands between angle brackets, types with types inside."""
        out = []
        while self.peek() and not self.accept(">"):
            self.modifiers()
            if self.accept(",", "&", "?") or self.peek() in ("extends", "super"):
                if self.peek() in ("extends", "super"):
                    self.at += 1
            elif self.named():
                out.append(self.type())
            else:
                self.at += 1
        return out

    def type(self) -> Type:
        """A name with its arguments and dimensions; of a nested type the parts are joined."""
        node = Type(self.take())
        while True:
            if self.accept("<"):
                node.arguments += self.arguments()
            elif self.accept("["):
                self.accept("]")
            elif self.accept("."):
                node.name += "." + self.take()
            elif not self.accept("..."):
                return node

    def parameters(self) -> list[tuple[str, str]]:
        """Type and name of each; a name alone is a type."""
        out = []
        while self.peek() and not self.accept(")"):
            self.modifiers()
            if not self.named():
                self.at += 1
                continue
            kind = self.type()
            out.append((kind.name, self.take() if self.named() else ""))
        return out


def parse_signature(id_: str, signature: str) -> Function:
    """The function node of a signature; what cannot be read there is taken from the id."""
    owner, _, member = id_.partition("#")
    reader = _Reader(signature)
    modifiers, kinds = reader.modifiers(), []
    if reader.accept("<"):
        reader.arguments()
    while reader.peek() and reader.peek() != "(":
        modifiers += reader.modifiers()
        if reader.named():
            kinds.append(reader.type())
        elif reader.peek() != "(":
            reader.at += 1
    opened = reader.accept("(")
    name = kinds[-1].name if kinds and opened else member.partition("(")[0]
    return Function(name, owner, modifiers, kinds[-2].name if len(kinds) > 1 else "", reader.parameters() if opened else [])


def _text(raw: str) -> str:
    """Text without markup: of inline tags, code stays and references go."""
    raw = _INLINE.sub(lambda m: f" {m[2]} " if m[1] in ("code", "literal", "value", "summary", "index", "return") else " ", raw)
    return html.unescape(_HTML.sub(" ", raw))


def _sentences(lines: list[str]) -> list[str]:
    """Sentences of the lines that are neither code nor notes of a generator or a placeholder."""
    kept = []
    for line in lines:
        line = _text(line)
        for part in _SENTENCE.split(line.replace("; ", "; ")):
            if not part.strip() or _EMPTY_NOTE.search(part):
                continue
            kept.append(part.strip())
    return kept


def parse_comment(doc: str) -> Comment:
    """The tree of a comment in any of the usual marks, or without them."""
    doc = re.sub(r"\r\n?|\u0085| ", "\n", doc.strip())
    doc = re.sub(r"^/\*+|\*+/$", "", doc)
    doc = _HTML.sub(lambda m: "\n" if re.match(r"</?(?:p|br|li|ul|ol|div|pre|tr|h\d)\b", m[0], re.I) else " ", doc)
    blocks: list[tuple[str | None, list[str]]] = [(None, [])]
    for raw in doc.split("\n"):
        line = _MARK.sub("", raw)
        tag = _TAG.match(line)
        if tag and not _INLINE.match(line.lstrip()):
            blocks.append((tag[1], [tag[2]]))
        elif not _text(line).strip() and blocks[-1][0] is None:
            continue
        elif _CODE.search(_text(line).strip()) and not regex.search(r"\p{Ll}{2,} \p{Ll}{2,} \p{Ll}{2,} \p{Ll}{2,}", line):
            continue
        elif blocks[-1][0] is not None and (blocks[-1][0] not in TELLING_TAGS or not raw.strip(" *\t")):
            blocks.append((None, [line]))
        else:
            blocks[-1][1].append(line)
    description, tags = [], []
    for tag, lines in blocks:
        if tag is None:
            description += _sentences(lines)
            continue
        about = ""
        if tag in ("param", "throws", "exception"):
            about, _, lines[0] = lines[0].partition(" ")
        if tag in TELLING_TAGS:
            tags.append((tag, about, _sentences(lines)))
        elif tag.lower() not in ("see", "since", "author", "version", "inheritdoc", "generated", "link", "date", "category", "hidden", "override", "nonnull", "nullable") and len(lines) > 1:
            tags.append((tag, "", _sentences(lines[1:])))
    return Comment(description, tags)


def _stem(word: str) -> str:
    """A word without its endings, the same for the forms of a regular English verb or noun."""
    for end in ("ing", "ies", "ied", "es", "ed", "s"):
        if word.endswith(end) and len(word) - len(end) >= 2:
            word = word[: -len(end)]
            break
    if len(word) > 3 and word[-1] == word[-2]:
        word = word[:-1]
    return word.rstrip("eyi") or word


def _pieces(name: str) -> list[str]:
    return [p.lower() for p in _CAMEL.findall(name)]


def said(function: Function, comment: Comment) -> tuple[str, int]:
    """The description that a comment gives, and how many words of it no name around the function says."""
    names = {_stem(p) for n in (function.name, function.owner.rpartition(".")[2], *(n for _, n in function.parameters), *(t.rpartition(".")[2] for t, _ in function.parameters)) for p in _pieces(n)}
    whole = {n.lower() for n in (function.name, *(n for _, n in function.parameters)) if n}
    kept, new, east = [], set(), 0
    for about, sentences in [("", comment.description), *((a, s) for _, a, s in comment.tags)]:
        own = names | {_stem(p) for p in _pieces(about.rpartition(".")[2])}
        for sentence in sentences:
            here = set()
            for w in _WORD.findall(_EAST.sub(" ", sentence)):
                if w.lower() in whole:
                    continue
                here |= {p for p in _pieces(w) if p not in EMPTY_WORDS and not p.isdigit() and _stem(p) not in own}
            chars = len([c for c in _EAST.findall(sentence)])
            if here or chars:
                kept.append(sentence)
                new |= {_stem(p) for p in here}
                east += chars
    return " ".join(kept), len(new) + east // CHARACTERS_OF_A_WORD


def describe(id_: str, signature: str | None, doc: str | None) -> tuple[Function, str] | None:
    """The function node and its description, or None where there is nothing to pair."""
    if not signature or not signature.strip() or not doc or not doc.strip():
        return None
    function = parse_signature(id_, signature)
    text, words = said(function, parse_comment(doc))
    return (function, text) if words >= WORDS_SAID else None


def function_pairs(nodes: DataFrame) -> DataFrame:
    """id, signature, name, parameters, description, file, start_line, end_line of each function that its documentation tells something about.

    nodes: one row per id, with kind clean. Other kinds, null ids, null or blank signatures and docs have no row; extra columns are ignored. The place in the
    file is that of the node; null stays null."""
    schema = "id string, signature string, name string, n_parameters int, description string, file string, start_line int, end_line int"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if pair := describe(r["id"], r["signature"], r["doc"]):
                    rows.append((r["id"], r["signature"], pair[0].name, len(pair[0].parameters), pair[1], r["file"], r["start_line"], r["end_line"]))
            columns = list(zip(*rows)) if rows else [()] * 8
            types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in schema.split(", ")])

    functions = nodes.where(F.col("kind").isin("METHOD", "CONSTRUCTOR") & F.col("id").isNotNull() & F.col("signature").isNotNull() & F.col("doc").isNotNull())
    return functions.select("id", "signature", "doc", "file", "start_line", "end_line").mapInArrow(look, schema)
