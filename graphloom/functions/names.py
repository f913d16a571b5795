"""Parts of graph ids and words of names, as column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def owner(id_: Column | str) -> Column:
    """The class that owns a member id, or the id itself."""
    return F.substring_index(id_, "#", 1)


def member(id_: Column | str) -> Column:
    """What follows the first # of an id; null without one."""
    c = F.col(id_) if isinstance(id_, str) else id_
    at = F.locate("#", c)
    return F.when(at > 0, F.substr(c, at + 1))


def simple_name(id_: Column | str) -> Column:
    """What an id is called: the member without its parameters, or else the class without its package and outer classes."""
    head = F.substring_index(id_, "(", 1)
    return F.substring_index(F.when(F.contains(head, F.lit("#")), F.substring_index(head, "#", -1)).otherwise(F.substring_index(head, ".", -1)), "$", -1)


def short_class(id_: Column | str) -> Column:
    """The name of a class id without package and outer classes."""
    return F.substring_index(F.substring_index(id_, ".", -1), "$", -1)


def package(id_: Column | str) -> Column:
    """The package of a class id; empty without a dot."""
    c = F.col(id_) if isinstance(id_, str) else id_
    return F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.[^.]*$", "")).otherwise("")


def top_class(id_: Column | str) -> Column:
    """The outermost class of an id."""
    return F.substring_index(F.substring_index(id_, "#", 1), "$", 1)


def terms(fqn: Column | str) -> Column:
    """The words of a name; where camel case parts them, the parted form follows."""
    words = F.trim(F.regexp_replace(fqn, r"[.#$(),\[\]<>]+", " "))
    camel = F.regexp_replace(words, "([a-z0-9])([A-Z])", "$1 $2")
    return F.when(words == camel, words).otherwise(F.concat_ws(" ", words, camel))


def annotations(attrs: Column | str = "attrs") -> Column:
    """The annotations of a node, each with its members and their values, from its attributes; null where they hold none or no JSON."""
    return F.from_json(F.try_element_at(F.col(attrs) if isinstance(attrs, str) else attrs, F.lit("annotations")), "map<string,map<string,string>>")


def annotation_names(attrs: Column | str = "attrs") -> Column:
    """The simple names of a node's annotations; an empty list without any."""
    return F.coalesce(F.transform(F.map_keys(annotations(attrs)), lambda a: F.substring_index(a, ".", -1)), F.array().cast("array<string>"))


def annotation_terms(attrs: Column | str = "attrs") -> Column:
    """What the annotations of a node say, in words: the simple name of each and all values; null without any."""
    say = lambda e: F.concat_ws(" ", F.substring_index(e["key"], ".", -1), F.array_join(F.map_values(e["value"]), " "))
    return terms(F.array_join(F.transform(F.map_entries(annotations(attrs)), say), " "))


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def _undouble(word: Column) -> Column:
    """Of a word of more than three letters one less where the last two are the same consonant other than l, s and z."""
    return F.when((F.length(word) > 3) & word.rlike(r"([^lszaeiou])\1$"), F.substr(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def stem(word: Column | str) -> Column:
    """A word in lower case without the commonest English endings."""
    w = F.lower(word)
    cut = lambda n: F.substr(w, F.lit(1), F.length(w) - n)
    return (
        F.when((F.length(w) > 5) & F.endswith(w, F.lit("ing")), _undouble(cut(3)))
        .when((F.length(w) > 4) & F.endswith(w, F.lit("ied")), F.concat(cut(3), F.lit("y")))
        .when((F.length(w) > 4) & F.endswith(w, F.lit("ed")), _undouble(cut(2)))
        .when((F.length(w) > 4) & F.endswith(w, F.lit("ies")), F.concat(cut(3), F.lit("y")))
        .when((F.length(w) > 3) & F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), cut(1))
        .otherwise(w)
    )


def ant_pattern(pattern: Column) -> Column:
    """A path pattern with ** (any path), * (one part) and {name} (one part) as a regular expression for the whole path."""
    quoted = F.regexp_replace(pattern, r"([.+^$()|\[\]\\?])", r"\\$1")
    parts = F.regexp_replace(F.regexp_replace(quoted, r"\{[^{}]*\}", "[^/]+"), r"\*\*", "\u0001")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(parts, r"\*", "[^/]*"), "\u0001", ".*"), F.lit("$"))


def first_sentence(doc: Column) -> Column:
    """The first sentence of a comment without markup, of more than 200 characters the words that fit; null where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(doc, r"\{@(?:code|link|linkplain)[ \t\r\n\f]+([^}]*)\}", "$1"), "<[^>]+>", " ")
    text = F.trim(F.regexp_replace(bare, "[ \t\r\n\f]+", " "))
    first = F.regexp_extract(text, "^(.*?[.!?])( |$)", 1)
    sentence = F.when(first == "", text).otherwise(first)
    short = F.concat(F.regexp_replace(F.substring(sentence, 1, 200), " [^ ]*$", ""), F.lit(" ..."))
    return F.when(text != "", F.when(F.length(sentence) <= 200, sentence).otherwise(short))


def placeholder_key(text: Column) -> Column:
    """The key of the first ${key} or ${key:default} in a text; null without one."""
    key = F.regexp_extract(text, r"\$\{([^}:]+)(:[^}]*)?\}", 1)
    return F.when(key != "", key)


def with_defaults(value: Column) -> Column:
    """A value whose placeholders with a default are replaced by it; those without stay."""
    return F.regexp_replace(value, r"\$\{[^}:]+:([^}]+)\}", "$1")
