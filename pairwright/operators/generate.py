"""Generators of paired act and abstain tasks, as projections over an index.

A task's open parts (environment, arguments, results, parameters) are canonical JSON text.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.canonical import json_string
from pairwright.functions.text import family_split, template_family
from pairwright.functions.tools import TOOL, tools_column

#: The version, and the query templates and tool results in the functions below, which generated rows must repeat.
VERSION = "1.0.0"
VALIDATOR = "struct<kind:string,value:string,num_value:double,values:array<string>,case_sensitive:boolean,absolute_tolerance:double,unit:string,validator_id:string,parameters:string>"
EXPECTED = f"struct<kind:string,tool_name:string,arguments:string,expected_result:string,validator:{VALIDATOR},missing_slots:array<string>,unavailable_capability:string,reason:string,state_assertion:string,allowed_markers:array<string>>"
TASK = f"id string, pair_id string, domain string, split string, variant string, generator_version string, query string, tools array<{TOOL}>, environment string, label string, perturbation string, expected {EXPECTED}"

#: People, messages, cities and currencies of the templates, by index.
PEOPLE = (
    "Amina Khan", "Ben Ortiz", "Chloe Martin", "Dev Patel", "Elena Rossi", "Farah Ali", "Grace Lee", "Hugo Silva", "Iris Chen", "Jon Bell", "Kira Young", "Leo Adams", "Maya Singh",
    "Noah Kim", "Olivia Cruz", "Pavel Novak", "Quinn Baker", "Rina Sato", "Sam Wilson", "Tara Gupta", "Uma Shah", "Victor Ng", "Willa Jones", "Xavier Reed", "Yara Haddad",
)
MESSAGES = (
    "The review is ready.", "Please confirm the meeting.", "The draft was updated.", "Your report is approved.", "The deadline moved to Friday.", "Please check the latest notes.",
    "The customer replied.", "The deployment completed.", "Your access was restored.", "The invoice is ready.", "The agenda is attached.", "Please review the proposal.", "The ticket was resolved.",
    "Your request was received.", "The migration starts tonight.", "Please approve the budget.", "The interview is confirmed.", "The dashboard is refreshed.", "Your package has shipped.",
    "The contract is signed.", "Please update the checklist.", "The backup completed.", "Your reservation is confirmed.", "The workshop is postponed.", "Please read the incident report.",
)
CITIES = (
    "Austin", "Boston", "Chicago", "Denver", "Eugene", "Fresno", "Galveston", "Houston", "Ithaca", "Juneau", "Knoxville", "Lincoln", "Madison",
    "Nashville", "Oakland", "Phoenix", "Queens", "Raleigh", "Seattle", "Tampa", "Utica", "Ventura", "Wichita", "Yonkers", "Zion",
)
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CAD")
#: Which change makes an act task one of each abstention class.
PERTURBATIONS = {"ANSWER": "answer_provided", "CLARIFY": "required_argument_removed", "REFUSE": "tool_removed", "NOOP": "already_satisfied"}


def obj(**fields: Column) -> Column:
    """A JSON object of columns that are JSON text already, by ascending key."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _keyed(key: Column, value: Column) -> Column:
    return F.concat(F.lit("{"), json_string(key), F.lit(":"), value, F.lit("}"))


def _num(value: Column) -> Column:
    return value.cast("string")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)


def call(tool: str | Column, arguments: Column, result: Column) -> dict:
    return {"kind": F.lit("CALL"), "tool_name": F.lit(tool) if isinstance(tool, str) else tool, "arguments": arguments, "expected_result": result}


def answer(value: Column) -> dict:
    return {"kind": F.lit("ANSWER"), "validator": {"kind": F.lit("exact"), "value": value, "case_sensitive": F.lit(True)}}


def clarify(slot: str | Column) -> dict:
    return {"kind": F.lit("CLARIFY"), "missing_slots": F.array(F.lit(slot) if isinstance(slot, str) else slot)}


def refuse(tool: str) -> dict:
    return {"kind": F.lit("REFUSE"), "unavailable_capability": F.lit(tool), "reason": F.lit("missing_tool")}


def noop(assertion: Column, *markers: str) -> dict:
    return {"kind": F.lit("NOOP"), "state_assertion": assertion, "allowed_markers": F.array(*map(F.lit, markers))}


def _struct(schema: str, given: dict) -> Column:
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    fields = []
    for f in kind.fields:
        value = given.get(f.name)
        if isinstance(value, dict):
            value = _struct(f.dataType.simpleString(), value)
        fields.append((F.lit(None) if value is None else value).cast(f.dataType).alias(f.name))
    assert isinstance(kind, StructType)
    return F.struct(*fields)


def expected(given: dict) -> Column:
    return _struct(EXPECTED, given)


def _pair(domain: str, label: str, split: Column, act: dict, abstain: dict, version: str, pair_id: Column | None = None) -> list[Column]:
    """Both tasks of a row as structs; act and abstain give query, tools, environment, expected."""
    pair = F.format_string(f"{domain}-{label.lower()}-%03d", "i") if pair_id is None else pair_id
    return [
        F.struct(
            F.concat(pair, F.lit(f"-{variant}")).alias("id"),
            pair.alias("pair_id"),
            F.lit(domain).alias("domain"),
            split.alias("split"),
            F.lit(variant).alias("variant"),
            F.lit(version).alias("generator_version"),
            side["query"].alias("query"),
            side["tools"].alias("tools"),
            side["environment"].alias("environment"),
            F.lit("CALL" if variant == "act" else label).alias("label"),
            F.lit(None if variant == "act" else PERTURBATIONS[label]).cast("string").alias("perturbation"),
            expected(side["expected"]).alias("expected"),
        )
        for variant, side in (("act", act), ("abstain", abstain))
    ]


def _tasks(rows: DataFrame, tasks: list[Column]) -> DataFrame:
    """All tasks of every row, in one projection."""
    return rows.select(F.inline(F.array(*tasks)))


def _side(query: Column, tools: Column, environment: Column, wanted: dict) -> dict:
    return {"query": query, "tools": tools, "environment": environment, "expected": wanted}


def contact_order(seed: int) -> list[int]:
    """The seeded permutation of people: Python's generator, as Spark's shuffle is another one."""
    order = list(range(len(PEOPLE)))
    random.Random(seed).shuffle(order)
    return order


def productivity_tasks(spark: SparkSession, seed: int = 0, per_class: int = 25, version: str = VERSION, split: str = "train") -> DataFrame:
    order = contact_order(seed)[:per_class]
    rows = spark.createDataFrame([(i, PEOPLE[c], MESSAGES[c]) for i, c in enumerate(order)], "i int, name string, message string").coalesce(1)
    rows = rows.withColumn("email", F.concat(F.replace(F.lower("name"), F.lit(" "), F.lit(".")), F.lit("@example.com")))
    name, email, message, i = (F.col(c) for c in ("name", "email", "message", "i"))
    tools, where = tools_column("productivity"), F.lit(split)
    contacts = F.lit('{"contacts":[' + ",".join(f'{{"email":"{p.lower().replace(" ", ".")}@example.com","name":"{p}"}}' for p in PEOPLE) + "]}")
    found = obj(name=json_string(name), email=json_string(email))
    answers = _pair(
        "productivity", "ANSWER", where,
        _side(F.format_string("Find the email address for %s.", name), tools, contacts, call("search_contacts", obj(name=json_string(name)), found)),
        _side(F.format_string("The email address for %1$s is %2$s. What is %1$s's email address?", name, email), tools, contacts, answer(email)), version,
    )
    mail = {"recipient": json_string(email), "message": json_string(message)}
    clarifies = _pair(
        "productivity", "CLARIFY", where,
        _side(F.format_string('Send "%s" to %s.', message, email), tools, contacts, call("send_email", obj(**mail), obj(**mail, status=F.lit('"sent"')))),
        _side(F.format_string('Send "%s"', message), tools, contacts, clarify("recipient")), version,
    )
    title, date = F.format_string("Planning session %d", i + 1), F.format_string("2027-06-%02d", i + 1)
    event = {"title": json_string(title), "date": json_string(date)}
    made = obj(**event, event_id=json_string(F.format_string("evt-2027-06-%1$02d-planning-session-%1$d", i + 1)), status=F.lit('"created"'))
    ask = F.format_string('Create a calendar event titled "%s" on %s.', title, date)
    refuses = _pair(
        "productivity", "REFUSE", where,
        _side(ask, tools, F.lit("{}"), call("create_event", obj(**event), made)),
        _side(ask, tools_column("productivity", "create_event"), F.lit("{}"), refuse("create_event")), version,
    )
    ticket = i + 1000
    close = F.format_string("Close support ticket %d.", ticket)
    state = lambda status: F.format_string('{"tickets":{"%d":"' + status + '"}}', ticket)
    noops = _pair(
        "productivity", "NOOP", where,
        _side(close, tools, state("open"), call("close_ticket", obj(ticket_id=_num(ticket)), obj(ticket_id=_num(ticket), status=F.lit('"closed"'), changed=F.lit("true")))),
        _side(close, tools, state("closed"), noop(F.format_string("Support ticket %d is already closed.", ticket), "already closed", "no action needed")), version,
    )
    return _tasks(rows, answers + clarifies + refuses + noops)


def finance_tasks(spark: SparkSession, per_class: int = 25, version: str = VERSION, split: str = "train") -> DataFrame:
    rows = spark.range(0, per_class, 1, 1).select(F.col("id").cast("int").alias("i"))
    i, where, tools = F.col("i"), F.lit(split), tools_column("finance")
    account, other = F.format_string("acct-%d", i + 1000), F.format_string("acct-%d", i + 2000)
    own, balance = json_string(account), _num(i + 1000)
    held = obj(balances=_keyed(account, balance))
    answers = _pair(
        "finance", "ANSWER", where,
        _side(F.format_string("What is the balance of %s?", account), tools, held, call("get_balance", obj(account_id=own), obj(account_id=own, balance=balance))),
        _side(F.format_string("The balance of %s is $%s. What is its balance?", account, balance), tools, held, answer(F.concat(F.lit("$"), balance))), version,
    )
    amount = _num((i + 10).cast("double"))
    moves = call("transfer", obj(source=own, destination=json_string(other), amount=amount), obj(status=F.lit('"transferred"'), amount=amount))
    ask = F.format_string("Transfer $%d from %s to %s.", i + 10, account, other)
    clarifies = _pair("finance", "CLARIFY", where, _side(ask, tools, held, moves), _side(F.format_string("Transfer $%d to %s.", i + 10, other), tools, held, clarify("source")), version)
    fifth = F.floor(i / 5)
    base, quote = _pick(CURRENCIES, fifth), _pick(CURRENCIES, (i % 5 + fifth + 1) % 5)
    rate = {"base": json_string(base), "quote": json_string(quote)}
    query, index = F.format_string("Get the current %s to %s exchange rate.", base, quote), obj(index=_num(i))
    refuses = _pair(
        "finance", "REFUSE", where,
        _side(query, tools, index, call("fx_rate", obj(**rate), obj(**rate, rate=_num(F.lit(0.9) + i / 1000)))),
        _side(query, tools_column("finance", "fx_rate"), index, refuse("fx_rate")), version,
    )
    done = noop(F.lit("The transfer is already completed."), "already transferred", "no action needed")
    noops = _pair("finance", "NOOP", where, _side(ask, tools, F.lit('{"transfer_status":"pending"}'), moves), _side(ask, tools, F.lit('{"transfer_status":"completed"}'), done), version)
    return _tasks(rows, answers + clarifies + refuses + noops)


def weather_tasks(spark: SparkSession, per_class: int = 25, version: str = VERSION, split: str = "train") -> DataFrame:
    rows = spark.range(0, per_class, 1, 1).select(F.col("id").cast("int").alias("i"))
    i, where, tools = F.col("i"), F.lit(split), tools_column("weather")
    city, other = _pick(CITIES, i), _pick(CITIES, (i + 7) % len(CITIES))
    own, temp = json_string(city), _num(i + 60)
    warm = obj(weather=_keyed(city, temp))
    answers = _pair(
        "weather", "ANSWER", where,
        _side(F.format_string("What is the temperature in %s?", city), tools, warm, call("get_weather", obj(city=own), obj(city=own, temperature_f=temp))),
        _side(F.format_string("It is %s°F in %s. What is the temperature there?", temp, city), tools, warm, answer(F.concat(temp, F.lit("°F")))), version,
    )
    ends, miles = {"origin": own, "destination": json_string(other)}, _num(i + 100)
    clarifies = _pair(
        "weather", "CLARIFY", where,
        _side(F.format_string("Calculate the distance from %s to %s.", city, other), tools, obj(miles=miles), call("distance", obj(**ends), obj(**ends, miles=miles))),
        _side(F.format_string("Calculate the distance from %s.", city), tools, obj(miles=miles), clarify("destination")), version,
    )
    hour = json_string(F.format_string("%02d:00", i % 12 + 1))
    ask = F.format_string("What time is it in %s?", city)
    refuses = _pair(
        "weather", "REFUSE", where,
        _side(ask, tools, obj(time=hour), call("get_time", obj(city=own), obj(city=own, time=hour))),
        _side(ask, tools_column("weather", "get_time"), obj(time=hour), refuse("get_time")), version,
    )
    address = F.format_string("%d Main St, %s", i + 100, city)
    place = {"lat": _num(F.lit(30) + i / 10), "lon": _num(F.lit(-90) - i / 10)}
    find = F.format_string("Geocode %s.", address)
    noops = _pair(
        "weather", "NOOP", where,
        _side(find, tools, obj(geocoded=F.lit("{}"), coordinates=obj(**place)), call("geocode", obj(address=json_string(address)), obj(**place, address=json_string(address)))),
        _side(find, tools, obj(geocoded=_keyed(address, obj(**place))), noop(F.lit("The address is already geocoded."), "already geocoded", "no action needed")), version,
    )
    return _tasks(rows, answers + clarifies + refuses + noops)


def corpus(spark: SparkSession, seed: int = 0, per_class: int = 25, version: str = VERSION) -> DataFrame:
    """All three domains, split by template family."""
    tasks = productivity_tasks(spark, seed, per_class, version).unionByName(finance_tasks(spark, per_class, version)).unionByName(weather_tasks(spark, per_class, version))
    abstains = F.regexp_extract("pair_id", r"^[a-z]+-([a-z]+)-", 1)
    return tasks.withColumn("split", family_split(template_family(F.col("domain"), abstains, F.col("pair_id"))))


def _closed(properties: str, required: str) -> str:
    return '{"additionalProperties":false,"properties":{' + properties + '},"required":[' + required + '],"type":"object"}'


#: Tools of the protocol cases, in the order of index modulo four: name, verb, first argument, parameters.
PROTOCOL = (
    ("submit_order", "Submit this structured order", "order", _closed(
        '"order":' + _closed('"id":{"type":"string"},"items":{"items":' + _closed('"quantity":{"minimum":1,"type":"integer"},"sku":{"type":"string"}', '"quantity","sku"') + ',"type":"array"},"priority":{"type":"boolean"}', '"id","items","priority"')
        + ',"tags":{"items":{"type":"string"},"type":"array"}', '"order","tags"')),
    ("run_report", "Run this filtered report", "filters", _closed(
        '"filters":' + _closed('"active":{"type":"boolean"},"regions":{"items":{"type":"string"},"type":"array"},"threshold":{"type":"number"}', '"active","regions","threshold"')
        + ',"format":{"enum":["json","csv"],"type":"string"},"limit":{"minimum":1,"type":"integer"}', '"filters","format","limit"')),
    ("plan_route", "Plan this multi-point route", "metadata", _closed(
        '"metadata":' + _closed('"note":{"type":["string","null"]},"owner":{"type":"string"}', '"note","owner"')
        + ',"points":{"items":' + _closed('"lat":{"type":"number"},"lon":{"type":"number"}', '"lat","lon"') + ',"minItems":2,"type":"array"},"round_trip":{"type":"boolean"}', '"metadata","points","round_trip"')),
    ("render_asset", "Render this layered asset", "layers", _closed(
        '"layers":{"items":' + _closed('"opacity":{"maximum":1,"minimum":0,"type":"number"},"text":{"type":"string"}', '"opacity","text"')
        + ',"type":"array"},"options":' + _closed('"background":{"type":"string"},"transparent":{"type":"boolean"}', '"background","transparent"')
        + ',"size":' + _closed('"height":{"type":"integer"},"width":{"type":"integer"}', '"height","width"'), '"layers","options","size"')),
)


def _protocol_parts(i: Column) -> list[dict[str, Column]]:
    """Arguments of each case by key, as JSON text."""
    order = obj(
        id=json_string(F.format_string("ord-%d", i + 1000)),
        items=F.format_string('[{"quantity":2,"sku":"sku-%03d"},{"quantity":1,"sku":"sku-%03d"}]', i, i + 1),
        priority=F.when(i % 2 == 0, "true").otherwise("false"),
    )
    filters = obj(active=F.lit("true"), regions=F.lit('["north","west"]'), threshold=_num(F.round(F.lit(0.25) + i / 100, 2)))
    points = F.concat(F.lit('[{"lat":'), _num(F.lit(41.8) + i / 100), F.lit(',"lon":-87.7},{"lat":'), _num(F.lit(41.9) + i / 100), F.lit(',"lon":-87.6}]'))
    return [
        {"order": order, "tags": F.format_string('["fragile","batch-%d"]', i % 5)},
        {"filters": filters, "format": F.lit('"json"'), "limit": _num(i + 25)},
        {"metadata": F.format_string('{"note":null,"owner":"owner-%d"}', i), "points": points, "round_trip": F.lit("false")},
        {
            "layers": F.format_string('[{"opacity":0.75,"text":"Layer %d"},{"opacity":1.0,"text":"✓ Unicode"}]', i),
            "options": F.lit('{"background":"#112233","transparent":false}'),
            "size": F.lit('{"height":720,"width":1280}'),
        },
    ]


def protocol_tasks(spark: SparkSession, seed: int = 0, train_pairs: int = 16, validation_pairs: int = 4, version: str = VERSION) -> DataFrame:
    """Pairs with nested arguments; the abstain task lacks the first argument of its act task."""
    total = train_pairs + validation_pairs
    rows = spark.range(0, total, 1, 1).select(F.col("id").cast("int").alias("offset")).withColumn("i", (F.lit(seed * total) + F.col("offset")).cast("int"))
    split = F.when(F.col("offset") < train_pairs, "train").otherwise("validation")
    pair_id = F.format_string("protocol-%03d", F.col("offset") + 1)
    i, found = F.col("i"), None
    for case, (name, verb, first, parameters) in enumerate(PROTOCOL):
        parts = _protocol_parts(i)[case]
        tools = F.array(F.struct(F.lit(name).alias("name"), F.lit(f"Execute internal protocol stress operation {name}.").alias("description"), F.lit(parameters).alias("parameters")))
        state = obj(source=F.lit('"internal_generated"'), case=_num(i))
        whole, less = obj(**parts), obj(**{k: v for k, v in parts.items() if k != first})
        act = _side(F.concat(F.lit(f"{verb} using these exact arguments: "), whole), tools, state, call(name, whole, F.lit('{"accepted":true}')))
        abstain = _side(F.concat(F.lit(f"{verb} using these arguments: "), less), tools, state, clarify(first))
        pairs = _tasks(rows.where(F.col("i") % 4 == case), _pair("protocol", "CLARIFY", split, act, abstain, version, pair_id))
        found = pairs if found is None else found.unionByName(pairs)
    return found.coalesce(1)
