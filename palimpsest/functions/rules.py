"""Rule-based intent and entity detection as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions.text import _c, bound

# --- fixed values: word lists, typo table, patterns, scores -------------------------------------------------
LEXICON = {
    "plan": ["todo", "to do", "finish", "complete", "deadline", "due", "by ", "截止", "到…之前", "期限", "finir", "terminer", "échéance", "d'ici", "avant "],
    "preference": ["prefer", "like", "dislike", "喜欢", "偏好", "更喜欢", "n'aime pas", "préfér"],
    "assign": ["assign", "delegate", "owner", "responsible", "指派", "分配", "负责人", "assigner", "attribuer", "déléguer", "responsable"],
    "schedule": ["meeting", "schedule", "call", "appoint", "rdv", "rendez", "会议", "安排", "预约", "réunion", "planifier", "programmer"],
    "query": ["who", "what", "when", "where", "why", "how", "谁", "什么", "什么时候", "哪里", "为何", "如何", "qui", "quoi", "quand", "où", "pourquoi", "comment"],
}
TYPOS = {
    "prefer": ["preffer", "prefr", "prefered", "preffered", "preferr", "prefrer"],
    "like": ["liek", "lke"],
    "dislike": ["dislke", "disliek"],
    "assign": ["assgin", "asign", "assigne"],
    "delegate": ["deleagte", "delagate", "delegte"],
    "owner": ["owenr"],
    "responsible": ["responsable", "repsonsible", "responisble"],
    "meeting": ["meetng", "meting", "meetign"],
    "schedule": ["scheduel", "schedual", "schedul"],
    "appoint": ["appint", "apoint", "appointmnet"],
    "tomorrow": ["tomorow", "tmrw", "tmr"],
    "deadline": ["deadlne", "deadeline"],
    "complete": ["compelete", "complet", "cmplete"],
    "finish": ["finsh", "finsih"],
    "préfér": ["preferer", "prefere", "préfere", "préfer", "prefferer"],
    "réunion": ["reunion", "reuinion", "reunoin"],
    "planifier": ["planifer", "planifir", "plannifier"],
    "terminer": ["termnier", "ternimer"],
    "attribuer": ["atribuer", "attrubuer"],
    "échéance": ["echeance", "echéance", "écheace"],
    "avant ": ["avnt ", "avan "],
}
PREFER_WORDS = ["prefer", "喜欢", "préfér"]
NEGATION = r"\b(no|not|don't|do not|无|不要|别|不|ne\s+pas|pas\b)"
TIME_CUE = r"\b(?:\d{1,2}(:\d{2})?\s*(am|pm))\b|(?:\b\d{1,2}h(\d{2})?\b)|(?:\b(?:today|tomorrow|tmrw|tmr|next (week|month))\b)|明天|今天|下周|下个月"
QUESTION = r"\b(who|what|when|where|why|how|qui|quoi|quand|où|pourquoi|comment|谁|什么|什么时候|哪里|为何|如何)\b"
IMPERATIVE = r"^\s*(schedule|finish|complete|assign|plan|call|meet|安排|完成|指派|计划|预约|planifier|terminer|attribuer|rendez[-\s]?vous)\b"
DUE_WORDS = r"\bby\b|\b之前\b|d'ici|avant\b"
RULES_V0 = [
    ("plan", r"\b(todo|to do|finish|complete|done|deadline|due|by \d{1,2}/\d{1,2}|\bby (mon|tue|wed|thu|fri|sat|sun)\b)"),
    ("preference", r"\b(prefer|like|love|hate|dislike|prefer[s]?)\b"),
    ("assign", r"\b(assign|delegate|owner|owned by|responsible)\b"),
    ("schedule", r"\b(meeting|call|schedule|at \d{1,2}(:\d{2})?\s*(am|pm)?|tomorrow|today|next (week|month))\b"),
    ("query", r"\b(who|what|when|where|why|how)\b"),
]
ISO_DATE = r"\b(20[2-9]\d-\d{2}-\d{2})\b"
SHORT_DATE = r"\b(\d{1,2}/\d{1,2})\b"
DAY_WORDS = {"today": 0, "tomorrow": 1, "tmr": 1, "next week": 7, "next month": 30}
WEEKDAY = r"\b(?:mon|tue|wed|thu|fri|sat|sun)(?:day)?\b"
QUANTITY = r"\b(\d+(?:\.\d+)?)\s*(kg|g|lb|lbs|gb|mb|ms|s|min|h|hours?)\b"
QUOTED = r"(['\"“”])(.+?)(['\"“”])"
TITLE_RUN = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z0-9]+){1,4})\b"
PREFERENCE = r"\bprefer(?:s|red)?\s+([^\.;,]+)$"
PROVIDER_TYPES = {
    "PERSON": "Person", "LOCATION": "Location", "ORGANIZATION": "Organization", "EVENT": "Event", "WORK_OF_ART": "Work", "CONSUMER_GOOD": "Item",
    "PHONE_NUMBER": "Phone", "ADDRESS": "Address", "DATE": "Time", "NUMBER": "Quantity", "PRICE": "Quantity", "OTHER": "Entity",
}
SLOT_KEYS = ["deadline", "owner", "priority", "date", "time_range"]
ENTITY_TYPES = ["Person", "Project", "Task", "Preference", "Artifact", "Time", "Quantity", "Other"]
INTENTS = ["plan", "assign", "schedule", "query", "preference", "note", "other"]
ENTITY_ATTRS = {
    "Time": ["iso", "time", "range", "grain"],
    "Quantity": ["value", "unit"],
    "Preference": ["polarity"],
    "Task": ["status_hint", "priority_hint"],
}
MIN_ENTITY_SCORE = 0.40
NOT_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
             "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "task", "project", "thing", "work"]
# -----------------------------------------------------------------------------------------------------------

_SPANS = "array<struct<text:string,start:int,end:int>>"
ENTITY = "struct<type:string,text:string,norm:string,start:int,end:int,score:double>"


def _like(col: Column, pattern: str, flags: str = "(?U)") -> Column:
    return F.regexp_like(col, F.lit(flags + pattern))


def contains_any(col, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [_c(col).contains(t) for t in terms])


def with_typos(terms: list[str]) -> list[str]:
    """The terms and their known misspellings; those that contain another listed term add nothing."""
    full = list(dict.fromkeys(t for term in terms for t in [term, *TYPOS.get(term, [])]))
    return [t for t in full if not any(o != t and o in t for o in full)]


def lexicon_match(col, intent: str) -> Column:
    return contains_any(col, with_typos(LEXICON[intent]))


def has_negation(col) -> Column:
    return _like(_c(col), NEGATION)


def has_time_cue(col) -> Column:
    return _like(_c(col), TIME_CUE)


def is_question(col) -> Column:
    return _c(col).contains("?") | _like(_c(col), QUESTION)


def looks_imperative(col) -> Column:
    return _like(_c(col), IMPERATIVE)


def intent_scores(col) -> dict[str, Column]:
    """Score per intent of a normalised text."""
    c = _c(col)
    on = lambda cond, w: F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    neg, imp = has_negation(c), looks_imperative(c)
    base = {k: on(lexicon_match(c, k), 1.0) for k in LEXICON}
    return {
        "plan": F.round(base["plan"] + on(imp, 0.7) + on(_like(c, DUE_WORDS), 0.5) + on(neg, 0.1), 6),
        "preference": F.round(base["preference"] + on(contains_any(c, with_typos(PREFER_WORDS)), 0.7) + on(neg, 0.3), 6),
        "assign": F.round(base["assign"] + on(imp, 0.5), 6),
        "schedule": F.round(base["schedule"] + on(has_time_cue(c), 1.0), 6),
        "query": F.round(base["query"] + on(is_question(c), 1.0), 6),
    }


def intent_label(col) -> Column:
    """Best intent; ties go to the earlier one; a time cue turns a tie with plan into schedule."""
    names = list(LEXICON)

    def facts(text):
        return F.struct(*[v.alias(k) for k, v in intent_scores(text).items()], has_time_cue(text).alias("cue"), is_question(text).alias("question"))

    def label(s):
        best = F.array_max(F.array(*[F.struct(s[k].alias("s"), F.lit(-i).alias("p"), F.lit(k).alias("k")) for i, k in enumerate(names)]))
        none = F.when(s["question"], "query").otherwise("other")
        return F.when(best["s"] <= 0, none).when((s["schedule"] >= s["plan"]) & s["cue"], "schedule").otherwise(best["k"])

    return bound(bound(col, facts), label)


def intent_rules_v0(col) -> Column:
    """First rule that matches wins."""
    out = None
    for label, pattern in RULES_V0:
        hit = _like(_c(col), pattern, "(?i)")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("other")


def find_all(col, pattern: str, template: str = "\u0001$1\u0002") -> Column:
    """Every match as struct(text, start, end) with byte offsets; group 1 is the span unless the template says otherwise.

    Matches are marked, the text is cut at the marks, and byte lengths are summed along the pieces.
    """
    c = _c(col)

    def step(a, piece):
        inside = F.substring_index(piece, "\u0002", 1)
        end = a["at"] + F.octet_length(inside)
        # what follows the span: the piece less the span and its one-byte mark
        after = end + F.octet_length(piece) - F.octet_length(inside) - 1
        return F.struct(after.alias("at"), F.concat(a["out"], F.array(F.struct(inside.alias("text"), a["at"].alias("start"), end.alias("end")))).alias("out"))

    def spans(pieces):
        begin = F.struct(F.octet_length(F.get(pieces, 0)).alias("at"), F.array().cast(_SPANS).alias("out"))
        return F.aggregate(F.slice(pieces, 2, 1 << 30), begin, step, lambda a: a["out"])

    # texts without a match skip all of it
    marked = F.split(F.regexp_replace(F.translate(c, "\u0001\u0002", "  "), pattern, template), "\u0001")
    return F.when(F.regexp_like(c, F.lit(pattern)), bound(marked, spans)).otherwise(F.array().cast(_SPANS))


def find_spans(col, needle: str, word: bool = False) -> Column:
    """All case-insensitive occurrences of a literal, with byte offsets; ``word`` asks for non-letter borders."""
    quoted = "".join("\\" + ch if not ch.isalnum() and ord(ch) < 128 else ch for ch in needle)
    edge = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])") if word else ("", "")
    return find_all(col, f"(?iu){edge[0]}({quoted}){edge[1]}")


def _entity(type_: str, text: Column, norm: Column, start: Column, end: Column, score) -> Column:
    return F.struct(F.lit(type_).alias("type"), text.alias("text"), norm.alias("norm"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(score).cast("double").alias("score"))


def _with(fn, value: Column):
    """One-argument lambda that passes ``value`` along (Spark counts lambda parameters)."""
    return lambda x: fn(x, value)


def extract_dates(col, today) -> Column:
    """array<struct<raw, iso, start, end>>: ISO dates, M/D of this year, day words, next weekday."""
    day = _c(today).cast("date")
    found = lambda m, iso: F.struct(m["text"].alias("raw"), iso.alias("iso"), m["start"].alias("start"), m["end"].alias("end"))
    iso = F.transform(find_all(col, ISO_DATE), lambda m: found(m, m["text"]))
    part = lambda m, i: F.lpad(F.get(F.split(m["text"], "/"), i), 2, "0")
    short = F.transform(find_all(col, SHORT_DATE), lambda m: found(m, F.concat_ws("-", F.lpad(F.year(day).cast("string"), 4, "0"), part(m, 0), part(m, 1))))
    out = [iso, short]
    for word, days in DAY_WORDS.items():
        first = F.slice(find_all(col, rf"(?i)\b({word})\b"), 1, 1)
        then = F.date_format(F.date_add(day, days), "yyyy-MM-dd")
        out.append(F.transform(first, _with(found, then)))
    week = F.slice(find_all(col, "(?i)(" + WEEKDAY + ")"), 1, 1)
    # strictly after today: 1..7 days ahead
    index = lambda m: F.position(F.lower(F.substring(m["text"], 1, 3)), F.lit("montuewedthufrisatsun"))
    ahead = lambda m: F.pmod(((index(m) - 1) / 3).cast("int") - F.weekday(day) + 6, F.lit(7)) + 1
    out.append(F.transform(week, lambda m: found(m, F.date_format(F.date_add(day, ahead(m).cast("int")), "yyyy-MM-dd"))))
    return F.concat(*out)


def extract_quantities(col) -> Column:
    """array<struct<raw, value, unit, start, end>>."""
    inner = QUANTITY.replace(r"\b(\d+(?:\.\d+)?)\s*(kg", r"\b(\d+(?:\.\d+)?\s*(?:kg")
    hits = find_all(col, "(?i)" + inner[: -len(r"\b")] + r")\b")
    number = lambda m: F.regexp_extract(m["text"], r"^(\d+(?:\.\d+)?)", 1)
    unit = lambda m: F.lower(F.regexp_extract(m["text"], r"([A-Za-z]+)$", 1))
    return F.transform(hits, lambda m: F.struct(m["text"].alias("raw"), number(m).cast("double").alias("value"), unit(m).alias("unit"), m["start"].alias("start"), m["end"].alias("end")))


def number_text(value: Column) -> Column:
    """A double as short text: 32, 2.5."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def extract_quoted_titlecase(col) -> Column:
    """array<struct<text, start, end>>: quoted spans, then runs of 2-5 capitalised words."""
    quoted = F.filter(F.transform(find_all(col, QUOTED, "$1\u0001$2\u0002$3"), lambda m: m.withField("text", F.trim(m["text"]))), lambda m: m["text"] != "")
    title = find_all(col, "(?U)" + TITLE_RUN)
    fit = lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), (m["start"] + F.octet_length(m["text"])).alias("end"))
    return F.concat(F.transform(quoted, fit), F.transform(title, fit))


def extract_preference(col) -> Column:
    """array of at most one struct<text, start, end>: what follows prefer / prefers / preferred up to the end."""
    hit = find_all(col, r"(?i)(\bprefer(?:s|red)?\s+)([^\.;,]+)$", "$1\u0001$2\u0002")
    fit = lambda m: F.struct(F.trim(m["text"]).alias("text"), m["start"].alias("start"), (m["start"] + F.octet_length(F.trim(m["text"]))).alias("end"))
    return F.transform(F.slice(hit, 1, 1), fit)


def preference_slot(col) -> Column:
    return F.get(extract_preference(col), 0)["text"]


def entities_v0(col, today) -> Column:
    """All rule-based entities of a text, in the order dates, quantities, preference, quoted and title runs."""
    dates = F.transform(extract_dates(col, today), lambda d: _entity("Time", d["raw"], d["iso"], d["start"], d["end"], 0.8))
    amounts = F.transform(extract_quantities(col), lambda q: _entity("Quantity", q["raw"], F.concat_ws(" ", number_text(q["value"]), q["unit"]), q["start"], q["end"], 0.75))
    wish = F.transform(extract_preference(col), lambda p: _entity("Preference", p["text"], p["text"], p["start"], p["end"], 0.8))
    names = F.transform(extract_quoted_titlecase(col), lambda m: _entity("Task", m["text"], m["text"], m["start"], m["end"], 0.7))
    return F.concat(dates, amounts, wish, names)


def slot_deadline(col, entities: Column) -> Column:
    """Norm of the first Time entity when the text says "by"."""
    first = F.get(F.filter(entities, lambda e: e["type"] == "Time"), 0)
    return F.when(_like(_c(col), r"\bby\b", "(?i)"), first["norm"])


def map_entity_type(col) -> Column:
    out = F.lit("Entity")
    for given, ours in PROVIDER_TYPES.items():
        out = F.when(_c(col) == given, F.lit(ours)).otherwise(out)
    return out


_MENTIONS = "array<struct<type:string,name:string,salience:double,mentions:array<struct<text:struct<content:string,beginOffset:int>>>>>"


def mention_entities(text, response) -> Column:
    """Entities x mentions of a provider response, located in the text by first occurrence (bytes)."""
    t = _c(text)
    ents = F.from_json(F.get_json_object(_c(response), "$.entities"), _MENTIONS)

    def one(e, m):
        said = F.coalesce(m["text"]["content"], e["name"], F.lit(""))
        at = F.position(F.lower(said), F.lower(t))
        start = F.when(at > 0, F.octet_length(F.substr(t, F.lit(1), at - 1))).otherwise(0)
        norm = F.when(F.coalesce(e["name"], F.lit("")) != "", e["name"]).otherwise(said)
        return F.struct(
            map_entity_type(e["type"]).alias("type"), said.alias("text"), norm.alias("norm"), start.cast("int").alias("start"),
            (start + F.octet_length(said)).cast("int").alias("end"), F.coalesce(e["salience"], F.lit(0.5)).alias("score"),
        )

    found = F.flatten(F.transform(ents, lambda e: F.transform(F.coalesce(e["mentions"], F.array()), lambda m: one(e, m))))
    return F.coalesce(found, F.array()).cast(f"array<{ENTITY}>")


def _named_other(norm: str):
    return lambda e: F.lower(e["norm"]) != norm.lower()


def _best_variant(text, entry: dict, used: Column) -> Column:
    """array of at most one entity: the longest, then earliest free occurrence of the entry's variants."""

    def taken(h):
        return F.exists(used, lambda o: F.greatest(h["start"], o["start"]) < F.least(h["end"], o["end"]))

    def shown(b):
        return _entity(entry["type"], b["text"], F.lit(entry["norm"]), b["start"], b["end"], 0.9)

    hits = F.concat(*[find_spans(text, v, v.lower() in entry.get("word", ())) for v in entry["variants"]])
    free = F.filter(hits, lambda h: ~taken(h))
    order = F.array_sort(F.transform(free, lambda h: F.struct((h["start"] - h["end"]).alias("neg"), h["start"].alias("start"), h["end"].alias("end"), h["text"].alias("text"))))
    return F.transform(F.slice(order, 1, 1), shown)


def inject_names(text, entities: Column, catalog: list[dict]) -> Column:
    """Add one entity per catalog name: its longest, then earliest variant that overlaps no span in use.

    ``catalog`` rows: norm, type, variants, word (variants that need word borders). Entries are settled in order.
    """
    spans = lambda es: F.transform(es, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end")))
    used, out = spans(entities), entities
    for entry in catalog:
        new = _best_variant(text, entry, used)
        out = F.concat(F.filter(out, _named_other(entry["norm"])), new)
        used = F.concat(used, spans(new))
    return out


def detect(text, response=None, catalog: list[dict] | None = None, suffix: str = "") -> Column:
    """Detection of one text: version, intent, entities, slots. ``suffix='-'`` gives the historical norm."""

    def body(norm):
        found = mention_entities(norm, response) if response is not None else F.array().cast(f"array<{ENTITY}>")
        wish = F.transform(extract_preference(norm), lambda p: _entity("Preference", p["text"], p["text"], p["start"], p["end"], 0.8))
        entities = F.concat(found, wish)
        if catalog:
            entities = inject_names(norm, entities, catalog)
        pairs = F.array(
            F.struct(F.lit("deadline").alias("k"), slot_deadline(norm, found).alias("v")),
            F.struct(F.lit("preference").alias("k"), preference_slot(norm).alias("v")),
        )
        return F.struct(
            F.lit("v1").alias("detector_version"),
            F.struct(intent_label(X.detector_norm(norm, suffix)).alias("label"), F.lit(0.7).alias("score")).alias("intent"),
            entities.alias("entities"),
            F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("slots"),
        )

    return bound(X.detector_norm(text, suffix), body)


DET_JSON = (
    "struct<detector_version:string,intent:struct<label:string,score:double>,"
    "entities:array<struct<type:string,text:string,norm:string,span:array<int>,attrs:map<string,string>,score:double>>,slots:map<string,string>>"
)


def parse_detection(col) -> Column:
    return F.from_json(_c(col), DET_JSON)


def det_valid(det: Column) -> Column:
    return det["intent"]["label"].isNotNull() & det["entities"].isNotNull() & det["slots"].isNotNull()


def _key_in(keys: list[str]):
    return lambda k, v: k.isin(keys)


def det_coerce(det: Column, min_score: float = MIN_ENTITY_SCORE) -> Column:
    """Clamp a detection to the allow-lists: intents, entity types and scores, attributes per type, slots."""
    label = F.when(det["intent"]["label"].isin(INTENTS), det["intent"]["label"]).otherwise("other")
    score = F.round(F.coalesce(det["intent"]["score"], F.lit(0.2)), 2)

    def attrs(e):
        out = F.map_filter(e["attrs"], lambda k, v: F.lit(False))
        for t, keys in ENTITY_ATTRS.items():
            out = F.when(e["type"] == t, F.map_filter(e["attrs"], _key_in(keys))).otherwise(out)
        return out

    def clean(e):
        text = F.coalesce(e["text"], F.lit(""))
        at = lambda i: F.coalesce(F.get(e["span"], i), F.lit(0))
        return F.struct(e["type"].alias("type"), text.alias("text"), F.coalesce(e["norm"], text).alias("norm"), F.array(at(0), at(1)).alias("span"), attrs(e).alias("attrs"), e["score"].alias("score"))

    good = F.filter(F.coalesce(det["entities"], F.array()), lambda e: e["type"].isin(ENTITY_TYPES) & (F.coalesce(e["score"], F.lit(0.0)) >= min_score))
    slots = F.map_filter(det["slots"], lambda k, v: k.isin(SLOT_KEYS))
    return F.struct(F.lit("det-v2").alias("detector_version"), F.struct(label.alias("label"), score.alias("score")).alias("intent"), F.transform(good, clean).alias("entities"), slots.alias("slots"))


def clean_detection(col) -> Column:
    """Parse, check and coerce a detection JSON; null when it is not valid."""
    return bound(parse_detection(col), lambda d: F.when(det_valid(d), det_coerce(d)))
