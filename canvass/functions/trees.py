"""Survey trees and replies as JSON text, taken apart by SQL functions: nothing leaves the JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions import let
from canvass.functions.text import encode_with_options, first_rule, norm_label, parse_number, strip, strip_html
from canvass.operators.relational import made_once
from canvass.session import shared_dir

NONE = "array<string>"
OBJECT = "struct<path:array<int>,at:string,body:string>"


def doubtful(text: Column) -> Column:
    """Whether a JSON text may hold a string that begins as an object or a list does. In other texts the first letter of a value tells its kind."""
    return text.rlike(r'"([\[{]|\\u00[57][bB])')


def _kind(value: Column) -> Column:
    return F.when(F.startswith(value, F.lit("{")), "OBJECT").when(F.startswith(value, F.lit("[")), "ARRAY").otherwise("OTHER")


def entries(body: Column, doubt: Column) -> Column:
    """The entries of a JSON object in the order of its text: array<struct<key, value, type>>, values as text, inner objects and arrays as JSON."""
    texts = F.map_entries(F.from_json(body, "map<string,string>"))
    kinds = F.transform(F.map_values(F.from_json(body, "map<string,variant>")), F.schema_of_variant)
    exact = F.transform(F.arrays_zip(texts.alias("t"), kinds.alias("k")), lambda x: F.struct(x["t"]["key"].alias("key"), x["t"]["value"].alias("value"), x["k"].alias("type")))
    return F.when(doubt, exact).otherwise(F.transform(texts, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), _kind(e["value"]).alias("type"))))


def _items(body: Column, doubt: Column) -> Column:
    """The items of a JSON array: array<struct<value, type>>."""
    texts = F.from_json(body, NONE)
    exact = F.arrays_zip(texts.alias("value"), F.transform(F.from_json(body, "array<variant>"), F.schema_of_variant).alias("type"))
    return F.when(doubt, exact).otherwise(F.transform(texts, lambda x: F.struct(x.alias("value"), _kind(x).alias("type"))))


def _below(node: Column, doubt: Column) -> Column:
    """The objects and arrays right below a node, each with its place."""
    inner = lambda x, i, mark: F.struct(F.concat(node["path"], F.array(i)).alias("path"), F.concat(node["at"], *mark).alias("at"), x["value"].alias("body"))
    held = lambda x: F.startswith(x["type"], F.lit("OBJECT")) | F.startswith(x["type"], F.lit("ARRAY"))
    # places and paths are made for what is held only
    of_array = F.transform(_items(node["body"], doubt), lambda x, i: F.when(held(x), inner(x, i, (F.lit("["), i, F.lit("]")))))
    of_object = F.transform(entries(node["body"], doubt), lambda x, i: F.when(held(x), inner(x, i, (F.lit("."), x["key"]))))
    return F.array_compact(F.when(F.startswith(node["body"], F.lit("{")), of_object).otherwise(of_array))


#: A string of a JSON text.
STRING = r'"(?:[^"\\]++|\\.)*+"'


def brackets(text: Column) -> Column:
    """The brackets of a JSON text that stand outside its strings."""
    return F.regexp_replace(text, STRING + r'|[^"\[\]{}]++', "")


def depth(brackets: Column) -> Column:
    """How deep the objects and arrays of a JSON text lie in each other, by its brackets."""
    step = F.transform(F.split(brackets, ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    return F.aggregate(step, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, c: F.struct((a["now"] + c).alias("now"), F.greatest(a["most"], a["now"] + c).alias("most")), lambda a: a["most"])


def deepest(rows: DataFrame, text: str) -> int:
    """The depth of the deepest text; those of one shape are looked at once."""
    return rows.select(brackets(F.col(text)).alias("b")).distinct().agg(F.max(depth(F.col("b")))).first()[0] or 0


def objects(rows: DataFrame, text: str, name: str = "objects") -> DataFrame:
    """rows with all objects of a JSON text, each before those within it and in the order of the text: array<struct<path, at, body>>.

    One pass finds how deep the deepest text is; as many steps then open one
    level each. Text that is no JSON has no objects, and an object that
    repeats a key has none below it.
    """
    levels = deepest(rows, text)
    # most objects and lists hold plain values alone and are not opened; a bracket within a text opens one for nothing
    opened = lambda x: x["body"].rlike(r"(?s)^.+[\[{]")
    root = F.filter(F.array(F.struct(F.array().cast("array<int>").alias("path"), F.lit("").alias("at"), F.ltrim(F.col(text)).alias("body"))), lambda x: F.try_parse_json(x["body"]).isNotNull() & x["body"].rlike(r"^[\[{]"))
    out, level = rows.withColumns({"__0": root, "__doubt": doubtful(F.col(text))}), [F.col("__0")]
    for i in range(1, levels):
        # a column of its own, so that a level is opened once
        out = out.withColumn(f"__{i}", F.flatten(F.transform(F.filter(f"__{i - 1}", opened), lambda node: _below(node, F.col("__doubt")))))
        level.append(F.col(f"__{i}"))
    found = F.filter(F.concat(*level), lambda x: F.startswith(x["body"], F.lit("{")))
    return made_once(out, **{name: F.array_sort(found)}).drop("__doubt", *(f"__{i}" for i in range(len(level))))


def bodies(text: Column, levels: int) -> Column:
    """The texts of all objects of a JSON text at most `levels` deep, in the order of `objects`: one search that steps into each object and over each string."""
    inner = ""
    for _ in range(levels - 1):
        inner = r'[\[{](?:[^"\[\]{}]++|%s%s)*+[\]}]' % (STRING, inner and "|" + inner)
    whole = r'\{(?:[^"\[\]{}]++|%s%s)*+\}' % (STRING, inner and "|" + inner)
    found = F.regexp_extract_all(text, F.lit(f"(?s){STRING}|(?=({whole}))[{{]"), F.lit(1))
    sound = F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*[\[{]")
    return F.when(sound, F.array_remove(found, "")).otherwise(F.array().cast(NONE))


def at(v: Column, *path: str) -> Column:
    """What stands at a path of keys of a variant."""
    return F.try_variant_get(v, "$" + "".join(f"['{k}']" for k in path), "variant")


def text_at(v: Column, *path: str) -> Column:
    return F.try_variant_get(v, "$" + "".join(f"['{k}']" for k in path), "string")


def texts_at(v: Column, *path: str) -> Column:
    """The items of an array as texts, null where there is none; an item that is null is the text None."""
    items = F.try_variant_get(v, "$" + "".join(f"['{k}']" for k in path), "array<variant>")
    return F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("None")))


def is_kind(v: Column, kind: str) -> Column:
    """Whether a variant is there and of a kind (OBJECT, ARRAY, STRING, BIGINT)."""
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def bulleted(q: Column, *keys: str) -> Column:
    """The texts of the first of these keys that holds a list with anything in it, blank ones left out."""
    full = F.filter(F.array(*(texts_at(q, k) for k in keys)), lambda x: F.size(x) > 0)
    return F.coalesce(F.filter(F.transform(F.get(full, F.lit(0)), strip), lambda x: x != ""), F.array().cast(NONE))


# Fixed names of where a question keeps what was said, and the mark before each part in the text form.
ANSWER = (("SelectedByPosition", "#"), ("SelectedText", "|"), ("Values", "~"))
WHOLE = r"^-*[0-9]+$"


def answer(said: Column) -> Column:
    """What an answer holds: for each of its keys struct<parts, many>, parts being null where there is nothing and of one item where it is no list."""

    def held(key: str) -> Column:
        held = F.struct(texts_at(said, key).alias("items"), text_at(said, key).alias("single"))
        return let(held, lambda h: F.struct(F.coalesce(h["items"], F.when(h["single"].isNotNull(), F.array(h["single"]))).alias("parts"), h["items"].isNotNull().alias("many"))).alias(key)

    return F.struct(*(held(k) for k, _ in ANSWER))


def form(a: Column) -> Column:
    """One text for an answer: its place as #3 or #1#2, else its text folded (several as |a|b|), else its values as ~4; null if there is none."""
    folded = lambda c: F.coalesce(norm_label(c), F.lit(""))
    place = lambda c: F.when(c.rlike(WHOLE), F.coalesce(c.try_cast("long").cast("string"), c)).otherwise(c)
    forms = []
    for (key, mark), part in zip(ANSWER, (place, folded, strip), strict=True):
        x = a[key]
        joined = F.concat(F.lit(mark), F.array_join(F.transform(x["parts"], part), mark))
        if part is folded:
            forms.append(F.when(x["many"], F.concat(joined, F.lit(mark))).otherwise(folded(F.get(x["parts"], F.lit(0)))))
        else:
            forms.append(F.when(x["many"], joined).otherwise(F.concat(F.lit(mark), F.get(x["parts"], F.lit(0)))))
        forms[-1] = F.when(x["parts"].isNotNull(), forms[-1])
    return F.coalesce(*forms)


def numbers(a: Column, options: Column) -> Column:
    """The parts of an answer as numbers, by its keys; texts are numbered by their options if there are any."""
    of_text = lambda c: F.when(F.size(options) > 0, encode_with_options(c, options).cast("double")).otherwise(parse_number(c))
    codes = {"SelectedByPosition": parse_number, "SelectedText": of_text, "Values": parse_number}
    return F.struct(*(F.struct(F.transform(a[k]["parts"], f).alias("codes"), a[k]["many"].alias("many")).alias(k) for k, f in codes.items()))


def chosen_numbers(n: Column) -> Column:
    """struct<several, codes, told>: of `numbers` the values, else the places, else the texts; no codes where one is no number.

    Values decide whether they are numbers or not; places that are not all
    numbers leave the answer to its texts, and told is false if there are none.
    """
    whole = lambda x: ~F.exists(x["codes"], lambda c: c.isNull())
    used = lambda x: F.struct((x["many"] & whole(x)).alias("several"), F.when(whole(x), x["codes"]).otherwise(F.array()).alias("codes"), F.lit(True).alias("told"))
    values, places, texts = n["Values"], n["SelectedByPosition"], n["SelectedText"]
    by_place = places["codes"].isNotNull() & (whole(places) | ~places["many"])
    nothing = F.struct(F.lit(False).alias("several"), F.array().cast("array<double>").alias("codes"), F.lit(False).alias("told"))
    return F.when(values["codes"].isNotNull(), used(values)).when(by_place, used(places)).when(texts["codes"].isNotNull(), used(texts)).otherwise(nothing)


# Fixed names of question types in surveys, and words of replies in the order in which they are tried.
SURVEY_TYPES = {"MC": "choice", "DB": "choice", "SAVR": "choice", "MAVR": "choice", "TE": "text", "TEXT": "text"}
SURVEY_STEMS = (("matrix", "MATRIX", False), ("slider", "SLIDER", True))
REPLY_WORDS = tuple((w, (w,)) for w in ("matrix", "slider", "text", "choice"))


def survey_type(q: Column, a: Column) -> Column:
    """choice, matrix, slider, text or other, of a question of a survey: by its name, else by its answer."""
    of_name = F.create_map(*(F.lit(x) for kv in SURVEY_TYPES.items() for x in kv))
    there = F.coalesce(a["SelectedByPosition"]["parts"], a["SelectedText"]["parts"]).isNotNull()

    def kind(name: Column) -> Column:
        stem = F.coalesce(*(F.when(F.contains(name, F.lit(w)) if anywhere else F.startswith(name, F.lit(w)), kind) for kind, w, anywhere in SURVEY_STEMS))
        return F.coalesce(F.element_at(of_name, name), stem, F.when(a["Values"]["parts"].isNotNull(), "slider").when(a["SelectedByPosition"]["many"], "matrix").when(there, "choice"), F.lit("other"))

    return let(F.upper(F.regexp_replace(strip(F.coalesce(text_at(q, "QuestionType"), F.lit(""))), '^"+|"+$', "")), kind)


def reply_type(cell: Column, a: Column) -> Column:
    """The same types, of an entry of a reply."""
    lists = a["SelectedByPosition"]["many"] | a["SelectedText"]["many"]

    def kind(name: Column) -> Column:
        named = let(first_rule(name, REPLY_WORDS, ""), lambda x: F.nullif(x, F.lit("")))
        return F.coalesce(named, F.when(name == "mc", "choice"), F.when(a["Values"]["parts"].isNotNull(), "slider").when(lists, "matrix"), F.lit("choice"))

    return let(F.lower(strip(F.coalesce(F.nullif(text_at(cell, "Question Type"), F.lit("")), text_at(cell, "QuestionType"), F.lit("")))), kind)


CHOICES = ("Options", "Columns", "Choices")


def _cells(rows: DataFrame, source: str, name: str, type_of) -> DataFrame:
    """rows with the cells of source, an array of struct<name, q, said, options>, made in steps of one column each."""
    steps = (
        lambda o: F.struct(o["name"].alias("name"), o["q"].alias("q"), o["options"].alias("options"), answer(o["said"]).alias("a")),
        lambda o: F.struct(o["name"].alias("name"), type_of(o["q"], o["a"]).alias("type"), form(o["a"]).alias("form"), numbers(o["a"], o["options"]).alias("n"), o["options"].alias("options")),
        lambda o: F.struct(o["name"].alias("name"), o["type"].alias("type"), o["form"].alias("form"), chosen_numbers(o["n"]).alias("n"), o["options"].alias("options"), F.when(F.size(o["options"]) >= 2, (F.size(o["options"]) - 1).cast("double")).alias("span")),
        lambda o: F.struct(o["name"].alias("name"), o["type"].alias("type"), o["form"].alias("form"), o["n"]["codes"].alias("codes"), o["n"]["several"].alias("several"), o["n"]["told"].alias("told"), o["options"].alias("options"), o["span"].alias("span")),
    )
    for step in steps:
        rows = rows.withColumn(source, F.transform(source, step))
    return made_once(rows, **{name: F.col(source)}).drop(source)


def survey_parts(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the texts of the objects of a survey tree that may be questions with an answer: array<struct<name, body>>."""
    # what does not spell the key, in letters or in escapes, is not parsed
    spelt = lambda b: F.contains(b, F.lit("Answers")) | F.contains(b, F.lit("\\u"))
    found = F.filter(bodies(F.col(text), deepest(rows, text)), spelt)
    return made_once(rows, **{name: F.transform(found, lambda b: F.struct(F.lit(None).cast("string").alias("name"), b.alias("body")))})


def survey_read(rows: DataFrame, source: str, name: str) -> DataFrame:
    parsed = rows.withColumn(source, F.transform(source, lambda o: F.try_parse_json(o["body"])))
    named = lambda q: F.coalesce(*(F.try_variant_get(q, f"$.Answers.{k}", "variant") for k, _ in ANSWER)).isNotNull()
    asked = F.transform(F.filter(source, named), lambda q: F.struct(F.lit(None).cast("string").alias("name"), q.alias("q"), F.try_variant_get(q, "$.Answers", "variant").alias("said"), bulleted(q, *CHOICES).alias("options")))
    return _cells(parsed.withColumn(source, asked), source, name, survey_type)


def survey_cells(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the questions of a survey tree whose Answers name a place, a text or values, an empty one too."""
    return read_once(survey_parts(rows, text, name), {name: survey_read})


def reply_parts(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the entries Q<n> of a reply, by number, that are objects: array<struct<name, body>>; a reply may be JSON within a JSON string."""
    body = F.when(is_kind(F.col("__v"), "STRING"), F.try_variant_get("__v", "$", "string")).otherwise(F.col(text))
    sound = F.when(is_kind(F.col("__v"), "STRING"), F.try_parse_json("__b").isNotNull()).otherwise(F.col("__v").isNotNull())
    here = made_once(made_once(rows, __v=F.try_parse_json(text)), __b=body).withColumn("__m", F.coalesce(F.when(sound, numbered(F.col("__b"))), F.array()))
    held = F.transform(F.filter("__m", lambda e: e["type"].startswith("OBJECT")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("body")))
    return made_once(here, **{name: held}).drop("__v", "__b", "__m")


def reply_read(rows: DataFrame, source: str, name: str) -> DataFrame:
    steps = (
        lambda e: F.struct(e["name"].alias("name"), F.try_parse_json(e["body"]).alias("q")),
        # answers stand in the entry or below it, and so do options
        lambda e: F.struct(e["name"].alias("name"), e["q"].alias("q"), F.when(F.schema_of_variant(F.try_variant_get(e["q"], "$.Answers", "variant")).startswith("OBJECT"), F.try_variant_get(e["q"], "$.Answers", "variant")).otherwise(e["q"]).alias("said")),
        lambda e: F.struct(e["name"].alias("name"), e["q"].alias("q"), e["said"].alias("said"), bulleted(e["q"], *CHOICES).alias("own"), bulleted(e["said"], *CHOICES).alias("below")),
        lambda e: F.struct(e["name"].alias("name"), e["q"].alias("q"), e["said"].alias("said"), F.when(F.size(e["own"]) > 0, e["own"]).otherwise(e["below"]).alias("options")),
    )
    for step in steps:
        rows = rows.withColumn(source, F.transform(source, step))
    cells = _cells(rows, source, name, reply_type)
    return made_once(cells, **{name: F.filter(name, lambda c: c["form"].isNotNull())})


def reply_cells(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the entries Q<n> of a reply, by number, that are objects with an answer."""
    return read_once(reply_parts(rows, text, name), {name: reply_read})


#: Texts of questions and entries whose cells every task may hold.
FEW = 100_000


def read_once(rows: DataFrame, readers: dict) -> DataFrame:
    """rows with the cells of the parts in each of these columns.

    Persons are asked the same and most answers are chosen, so few texts of
    questions and entries differ: each is read once, and its cell is looked up.
    Where they are too many to be sent to all tasks, each is read where it
    stands.
    """
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/canvass/cells-{uuid.uuid4().hex[:12]}"
    part = lambda i, c: F.transform(c, lambda p, k: F.struct(F.lit(i).alias("side"), k.alias("k"), p["name"].alias("name"), p["body"].alias("body")))
    parts = F.concat(*(part(i, F.col(c)) for i, c in enumerate(readers)))
    # trees are dear to open, and the texts of their parts repeat
    rows.write.parquet(f"{base}/parts")
    rows = spark.read.schema(rows.schema).parquet(f"{base}/parts")
    texts = rows.select(F.explode(parts).alias("p")).select("p.side", "p.body").distinct()
    texts.write.parquet(f"{base}/texts")
    texts = spark.read.schema(texts.schema).parquet(f"{base}/texts")
    if texts.count() > FEW:
        for c, reader in readers.items():
            rows = reader(rows.withColumnRenamed(c, "__p"), "__p", c)
        return rows
    known = None
    for i, reader in enumerate(readers.values()):
        one = texts.filter(F.col("side") == i).withColumn("__p", F.array(F.struct(F.lit(None).cast("string").alias("name"), "body")))
        read = reader(one, "__p", "__c").select("side", "body", F.explode("__c").alias("cell"))
        known = read if known is None else known.union(read)
    known.write.parquet(f"{base}/cells")
    known = spark.read.schema(known.schema).parquet(f"{base}/cells")
    # rows are dealt by their number before they grow, so that their parts meet again where they are
    others = [F.col(f"`{c}`") for c in rows.columns if c not in readers]
    dealt = rows.withColumn("__r", F.monotonically_increasing_id()).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "__r")
    long = dealt.select("__r", *others, F.explode_outer(parts).alias("p")).select("__r", *others, "p.*").join(F.broadcast(known), ["side", "body"], "left")
    cell = F.struct("k", F.col("cell").withField("name", F.col("name")).alias("cell"))
    made = long.groupBy("__r").agg(*(F.any_value(c).alias(n) for c, n in zip(others, [c for c in rows.columns if c not in readers], strict=True)), *(F.collect_list(F.when((F.col("side") == i) & F.col("cell").isNotNull(), cell)).alias(c) for i, c in enumerate(readers)))
    return made_once(made, **{c: F.transform(F.array_sort(c), lambda x: x["cell"]) for c in readers}).drop("__r")


def numbered(body: Column) -> Column:
    """The entries of an object with keys Q<n>, by number."""
    mine = F.filter(entries(body, doubtful(body)), lambda e: e["key"].rlike("^Q[0-9]+$"))
    ranked = F.array_sort(F.transform(mine, lambda e: F.struct(F.substring(e["key"], 2, 1 << 20).try_cast("decimal(38,0)").alias("n"), e["key"].alias("key"), e["value"].alias("value"), e["type"].alias("type"))))
    return F.transform(ranked, lambda e: F.struct(e["key"], e["value"], e["type"]))


PAIRS = "array<struct<human:int,model:int>>"


def aligned(human: Column, model: Column) -> Column:
    """Pairs of places of two arrays of types: by place if equally many, else along a longest common subsequence; of equally long ones that which gives up human cells first.

    Works backwards over the human side and keeps, for each place of the model
    side, the best pairs of what is left from there on.
    """
    none = F.array().cast(PAIRS)
    by_place = F.transform(F.sequence(F.lit(0), F.size(human) - 1), lambda i: F.struct(i.alias("human"), i.alias("model")))

    def row(below: Column, h: Column) -> Column:
        """below[j]: the pairs of later human cells with model cells from j on."""
        steps = F.reverse(F.transform(model, lambda t, j: F.struct(t.alias("t"), j.alias("j"), F.get(below, j).alias("skip"), F.get(below, j + 1).alias("rest"))))

        def cell(right: Column, s: Column) -> Column:
            taken = F.concat(F.array(F.struct(h["i"].alias("human"), s["j"].alias("model"))), s["rest"])
            ahead = F.get(right, F.lit(0))
            best = F.when(s["t"] == h["t"], taken).when(F.size(s["skip"]) >= F.size(ahead), s["skip"]).otherwise(ahead)
            return F.concat(F.array(best), right)

        return F.aggregate(steps, F.array(none), cell)

    cells = F.reverse(F.transform(human, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    start = F.array_repeat(none, F.size(model) + 1)
    longest = F.get(F.aggregate(cells, start, row), F.lit(0))
    return F.when((F.size(human) == 0) | (F.size(model) == 0), none).when(F.size(human) == F.size(model), by_place).otherwise(longest)


def priced(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the pricing questions of a survey tree under strict types: struct<items, error>, error being the first thing that is wrong."""

    def item(q: Column) -> Column:
        kinds = F.struct(is_kind(at(q, "Answers"), "OBJECT").alias("said"), is_kind(at(q, "Answers", "SelectedText"), "STRING").alias("chosen"), is_kind(at(q, "QuestionText"), "STRING").alias("asked"), is_kind(at(q, "Answers", "SelectedByPosition"), "BIGINT").alias("placed"))
        texts = F.struct(text_at(q, "QuestionID").alias("id"), text_at(q, "Answers", "SelectedText").alias("answer"), text_at(q, "QuestionText").alias("question"), F.try_variant_get(q, "$.Answers.SelectedByPosition", "bigint").alias("place"))

        def judged(x: Column) -> Column:
            k, t = x["k"], x["t"]
            wrong = (
                F.when(~k["said"], "has no Answers object for")
                .when(~k["chosen"], "has no text chosen for")
                .when(~k["asked"] | (strip(t["question"]) == ""), "has no text of")
                .when(~k["placed"], "has no whole place for")
                .when(let(strip(t["answer"]), lambda a: (a == "") | (a != t["answer"])), "has a blank or padded answer to")
            )
            return F.struct(t["id"].alias("question_id"), t["answer"].alias("answer"), t["place"].alias("answer_position"), t["question"].alias("question_text"), F.lit("wave4_Q_wave4_A").alias("source_column"), F.concat(wrong, F.lit(" "), t["id"]).alias("wrong"))

        return let(F.struct(kinds.alias("k"), texts.alias("t")), judged)

    def whole(asked: Column) -> Column:
        ids = F.transform(asked, lambda x: x["question_id"])
        faults = lambda names: F.transform(asked, lambda x, i: F.when(F.array_position(names, x["question_id"]) <= i, F.concat(F.lit("repeats "), x["question_id"])).otherwise(x["wrong"]))
        error = F.get(F.filter(let(ids, faults), lambda f: f.isNotNull()), F.lit(0))
        items = F.transform(asked, lambda x: F.struct(*(x[c].alias(c) for c in ("question_id", "answer", "answer_position", "question_text", "source_column"))))
        return let(error, lambda e: F.struct(F.when(e.isNull(), items).otherwise(F.filter(items, lambda x: F.lit(False))).alias("items"), e.alias("error")))

    found = made_once(rows, __o=F.transform(bodies(F.col(text), deepest(rows, text)), lambda b: F.try_parse_json(b)))
    mine = F.filter("__o", lambda q: F.coalesce(F.startswith(text_at(q, "QuestionID"), F.lit("QID9_")), F.lit(False)) & at(q, "QuestionText").isNotNull())
    return made_once(found, **{name: let(F.transform(mine, item), whole)}).drop("__o")


# Fixed names of question kinds.
KINDS = {"mc": "multiple_choice", "multiple choice": "multiple_choice", "matrix": "likert", "slider": "numeric"}


def label(said: Column) -> Column:
    """The readable answer: selected text, else free text, else values; '' if there is none."""
    joined = lambda items, mark: F.array_join(F.filter(F.transform(items, strip_html), lambda x: x != ""), mark)

    def written(key: str) -> Column:
        return let(strip_html(F.when(is_kind(at(said, key), "STRING"), text_at(said, key))), lambda x: F.nullif(x, F.lit("")))

    # entries of a free text may be objects, whose values are meant
    values = lambda v: F.coalesce(F.transform(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: F.try_variant_get(x, "$", "string")), F.array(F.try_variant_get(v, "$", "string")))
    free = F.flatten(F.transform(F.try_variant_get(said, "$.Text", "array<variant>"), values))
    return F.coalesce(joined(texts_at(said, "SelectedText"), "; "), written("SelectedText"), written("Text"), joined(free, "; "), joined(texts_at(said, "Values"), ", "), F.lit(""))


def survey_questions(rows: DataFrame, text: str, name: str = "questions") -> DataFrame:
    """rows with the questions of a survey tree in order: array<struct<block, pos, id, prompt, options, kind, gold>>.

    Questions stand in blocks, which stand at the top or below branches;
    those of type DB are left out, a matrix gives one for each of its rows.
    """
    at_element = r"^(\.Elements)?\[[0-9]+\](\.Elements\[[0-9]+\])*$"
    home = lambda o: F.regexp_extract(o["at"], r"^(.*)\.Questions\[[0-9]+\]$", 1)

    def blocks(elements: Column) -> Column:
        """Where the blocks stand: what they lie in must all be branches."""
        inside = lambda e, b: F.startswith(b["at"], F.concat(e["at"], F.lit(".Elements"))) & ~e["type"].eqNullSafe(F.lit("Branch"))
        mine = F.filter(elements, lambda b: b["type"].eqNullSafe(F.lit("Block")) & ~F.exists(elements, lambda e: inside(e, b)))
        return F.transform(mine, lambda b: b["at"])

    def facts(o: Column) -> Column:
        q, place = o["q"], F.regexp_extract(o["at"], r"\[([0-9]+)\]$", 1).cast("int") + 1
        either = lambda c, other: let(c, lambda x: F.when(x == "", other).otherwise(x))
        listed = F.get(F.filter(F.array(*(texts_at(q, k) for k in CHOICES[:2])), lambda x: F.size(x) > 0), F.lit(0))
        return F.struct(
            o["block"].alias("block"), either(strip_html(text_at(q, "QuestionID")), F.concat(F.lit("q"), place)).alias("id"), strip_html(text_at(q, "QuestionText")).alias("prompt"),
            F.coalesce(F.filter(F.transform(listed, strip_html), lambda x: x != ""), F.array().cast(NONE)).alias("options"), either(strip_html(text_at(q, "QuestionType")), F.lit("text")).alias("type"),
            F.transform(texts_at(q, "Rows"), strip_html).alias("rows"), label(at(q, "Answers")).alias("gold"), F.transform(texts_at(q, "Answers", "SelectedText"), strip_html).alias("chosen"),
        )

    def shown(f: Column, *rows: Column) -> Column:
        bullets = F.when(F.size(f["options"]) > 0, F.concat(F.lit("Options:\n- "), F.array_join(f["options"], "\n- ")))
        return F.array_join(F.filter(F.array(f["prompt"], *rows, bullets), lambda x: x.isNotNull() & (x != "")), "\n")

    def expanded(f: Column) -> Column:
        q = lambda name, prompt, kind, gold: F.struct(f["block"].alias("block"), name.alias("id"), prompt.alias("prompt"), f["options"].alias("options"), kind.alias("kind"), gold.alias("gold"))
        placed = F.filter(F.transform(f["rows"], lambda r, i: F.struct(r.alias("r"), i.alias("i"))), lambda x: x["r"] != "")
        rows = F.transform(placed, lambda x: q(F.concat(f["id"], F.lit(":"), x["i"] + 1), shown(f, x["r"]), F.when(F.size(f["options"]) > 0, "likert").otherwise("text"), F.coalesce(F.get(f["chosen"], x["i"]), F.lit(""))))
        kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.lower(f["type"])), F.lit("text"))
        return F.when((f["type"] == "Matrix") & (F.size(f["rows"]) > 0), rows).otherwise(F.array(q(f["id"], shown(f), kind, f["gold"])))

    def asked(os: Column) -> Column:
        elements = F.transform(F.filter(os, lambda o: o["at"].rlike(at_element)), lambda o: F.struct(o["at"].alias("at"), text_at(F.try_parse_json(o["body"]), "ElementType").alias("type")))
        found = lambda bs: F.transform(F.filter(os, lambda o: o["at"].rlike(r"\.Questions\[[0-9]+\]$") & F.array_contains(bs, home(o))), lambda o: F.struct(o["at"].alias("at"), (F.array_position(bs, home(o)) - 1).cast("int").alias("block"), F.try_parse_json(o["body"]).alias("q")))
        told = F.filter(F.transform(let(let(elements, blocks), found), facts), lambda f: f["type"] != "DB")
        return F.transform(F.flatten(F.transform(told, expanded)), lambda q, i: F.struct(q["block"].alias("block"), i.alias("pos"), *(q[c].alias(c) for c in ("id", "prompt", "options", "kind", "gold"))))

    return made_once(objects(rows, text, "__o"), **{name: let(F.col("__o"), asked)}).drop("__o")
