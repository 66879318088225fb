"""Schema.org types in JSON-LD text, read by Spark's own JSON functions."""

from pyspark.sql import Column, functions as F

#: Spark's JSON parser refuses what is nested deeper.
_PARSED_DEPTH = 1_000
#: An object or array still to be read: its place (child positions from the root) and text.
_OPEN = "array<struct<place:array<int>,json:string>>"
_FOUND = "array<struct<place:array<int>,types:array<string>>>"


def _bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def _members(json: Column) -> Column:
    """(name, text, value) of what an object or array holds, in order; the text of an
    object or array is its JSON, that of a string the string."""

    def pairs(texts, values, names):
        return F.transform(
            texts,
            lambda t, i: F.struct(
                F.get(names, i).alias("name") if names is not None else F.lit(None).cast("string").alias("name"),
                t.alias("text"), F.get(values, i).alias("value"),
            ),
        )

    texts, values = F.from_json(json, "map<string,string>"), F.from_json(json, "map<string,variant>")
    of_object = _bound(
        F.struct(texts.alias("texts"), values.alias("values")),
        lambda m: pairs(F.map_values(m["texts"]), F.map_values(m["values"]), F.map_keys(m["texts"])),
    )
    of_array = _bound(
        F.struct(F.from_json(json, "array<string>").alias("texts"), F.from_json(json, "array<variant>").alias("values")),
        lambda m: pairs(m["texts"], m["values"], None),
    )
    return F.when(json.startswith("{"), of_object).otherwise(of_array)


def _is_string(member: Column) -> Column:
    return F.schema_of_variant(member["value"]) == "STRING"


def _texts(members: Column) -> Column:
    return F.transform(F.filter(members, _is_string), lambda m: m["text"])


def _own_types(members: Column) -> Column:
    """Strings under ``@type``: one, or those of a list."""
    named = F.filter(members, lambda m: m["name"] == "@type")
    lists = F.filter(named, lambda m: m["text"].startswith("[") & ~_is_string(m))
    return F.concat(_texts(named), F.flatten(F.transform(lists, lambda m: _texts(_members(m["text"])))))


def _read(node: Column) -> Column:
    """What an open node gives: its own types and the open nodes in it that can hold more."""

    def parts(members):
        inner = F.transform(
            members,
            lambda m, i: F.when(
                m["text"].rlike(r'^[{\[]') & m["text"].contains('"@type"') & ~_is_string(m),
                F.struct(F.concat(node["place"], F.array(i)).alias("place"), m["text"].alias("json")),
            ),
        )
        return F.struct(_own_types(members).alias("types"), F.array_compact(inner).alias("open"))

    return _bound(_members(node["json"]), parts)


def _level(state: Column, _: Column) -> Column:
    """One level deeper, while something is open."""

    def next_state(read):
        types = F.zip_with(state["open"], read, lambda n, r: F.struct(n["place"].alias("place"), r["types"].alias("types")))
        some = F.filter(types, lambda t: F.size(t["types"]) > 0)
        return F.struct(F.flatten(read["open"]).alias("open"), F.concat(state["found"], some).alias("found"))

    return F.when(F.size(state["open"]) == 0, state).otherwise(_bound(F.transform(state["open"], _read), next_state))


def _depth(json: Column) -> Column:
    """How deep brackets are nested, at least 1: the innermost pairs are taken away until none is left."""
    brackets = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^{}\[\]]++", "")

    def inner(state, _):
        rest = F.regexp_replace(state["rest"], r"\{\}|\[\]", "")
        deeper = F.struct(rest.alias("rest"), (state["n"] + 1).alias("n"))
        return F.when(state["rest"] == "", state).otherwise(deeper)

    def count(text):
        start = F.struct(text.alias("rest"), F.lit(0).alias("n"))
        rounds = F.least(F.greatest(F.lit(1), F.length(text)), F.lit(_PARSED_DEPTH))
        return F.aggregate(F.sequence(F.lit(1), rounds), start, inner, lambda s: F.greatest(F.lit(1), s["n"]))

    return _bound(brackets, count)


def _one_value(json: Column) -> Column:
    """Whether a text is one JSON value and nothing more: a list of it has one member."""
    listed = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]")))
    return listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()


def jsonld_types(json: Column) -> Column:
    """Every ``@type`` at any depth, outer objects first, siblings as written; [] for invalid JSON.

    Objects are read level by level, so text is read once for each level it lies in; parts
    without ``@type`` are not read again.
    """
    start = F.struct(
        F.array(F.struct(F.array().cast("array<int>").alias("place"), F.trim(json).alias("json"))).cast(_OPEN).alias("open"),
        F.array().cast(_FOUND).alias("found"),
    )
    done = F.aggregate(F.sequence(F.lit(1), _depth(json)), start, _level, lambda s: F.flatten(F.transform(F.array_sort(s["found"]), lambda f: f["types"])))
    container = F.trim(json).rlike(r"^[{\[]") & json.contains('"@type"')
    return F.when(container & _one_value(json), done).otherwise(F.array().cast("array<string>"))


def microdata_type(itemtype: Column) -> Column:
    """Last path segment of an ``itemtype``; NULL when it is not a schema.org one."""
    name = F.regexp_extract(itemtype, r"([^/]*)/*$", 1)
    return F.when(itemtype.contains("schema.org"), name)
