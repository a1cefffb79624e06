"""Tool catalogs and their deterministic executors."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.canonical import canonical
from pairwright.functions.schemas import value_errors
from pairwright.functions.udf import vectorized


def _object(properties: dict, required: list[str] | None = None) -> dict:
    return {"type": "object", "properties": properties, "required": required or list(properties), "additionalProperties": False}


_TEXT, _FULL = {"type": "string"}, {"type": "string", "minLength": 1}

#: The tools of each domain with their parameters.
CATALOGS: dict[str, tuple[tuple[str, str, dict], ...]] = {
    "productivity": (
        ("search_contacts", "Find one contact by full name.", _object({"name": _FULL})),
        ("create_event", "Create a calendar event.", _object({"title": _FULL, "date": {"type": "string", "pattern": r"^2027-\d{2}-\d{2}$"}})),
        ("close_ticket", "Close an open support ticket.", _object({"ticket_id": {"type": "integer", "minimum": 1}})),
        ("send_email", "Send an email to an explicit address.", _object({"recipient": {"type": "string", "format": "email"}, "message": _FULL})),
    ),
    "finance": (
        ("get_balance", "Get an account balance.", _object({"account_id": _TEXT})),
        ("transfer", "Transfer money between accounts.", _object({"source": _TEXT, "destination": _TEXT, "amount": {"type": "number", "exclusiveMinimum": 0}})),
        ("list_transactions", "List recent account transactions.", _object({"account_id": _TEXT})),
        ("fx_rate", "Get a currency conversion rate.", _object({"base": _TEXT, "quote": _TEXT})),
    ),
    "weather": (
        ("get_weather", "Get current weather for a city.", _object({"city": _TEXT})),
        ("get_time", "Get local time for a city.", _object({"city": _TEXT})),
        ("geocode", "Get coordinates for an address.", _object({"address": _TEXT})),
        ("distance", "Compute distance between two cities.", _object({"origin": _TEXT, "destination": _TEXT})),
    ),
}

TOOL = "struct<name:string,description:string,parameters:string>"


def tools_column(domain: str, without: str | None = None) -> Column:
    """A domain's tools as array<struct<name,description,parameters JSON>>, one left out if named."""
    rows = [F.struct(F.lit(n).alias("name"), F.lit(d).alias("description"), F.lit(canonical(p)).alias("parameters")) for n, d, p in CATALOGS[domain]]
    tools = F.array(*rows)
    return tools if without is None else F.filter(tools, lambda t: t["name"] != without)


def _contact(a: dict, s: dict) -> object:
    return next((c for c in s.get("contacts", []) if c.get("name") == a["name"]), None)


def _event(a: dict, s: dict) -> object:
    return {"event_id": f"evt-{a['date']}-{'-'.join(str(a['title']).casefold().split())}", "title": str(a["title"]), "date": a["date"], "status": "created"}


def _ticket(a: dict, s: dict) -> object:
    status = s.get("tickets", {}).get(str(a["ticket_id"]))
    closes = status == "open"
    return {"ticket_id": a["ticket_id"], "status": "closed" if closes else status, "changed": closes}


Run = Callable[[dict, dict], object]
EXECUTORS: dict[str, dict[str, Run]] = {
    "productivity": {
        "search_contacts": _contact,
        "create_event": _event,
        "close_ticket": _ticket,
        "send_email": lambda a, s: {"recipient": a["recipient"], "message": a["message"], "status": "sent"},
    },
    "finance": {
        "get_balance": lambda a, s: {"account_id": str(a["account_id"]), "balance": s.get("balances", {})[str(a["account_id"])]},
        "transfer": lambda a, s: {"status": "transferred", "amount": a["amount"]},
        "list_transactions": lambda a, s: {"account_id": a["account_id"], "transactions": []},
        "fx_rate": lambda a, s: {"base": a["base"], "quote": a["quote"], "rate": 0.9 + int(str(s["index"])) / 1000},
    },
    "weather": {
        "get_weather": lambda a, s: {"city": str(a["city"]), "temperature_f": s.get("weather", {})[str(a["city"])]},
        "get_time": lambda a, s: {"city": a["city"], "time": s["time"]},
        "geocode": lambda a, s: {"address": a["address"], **s["coordinates"]},
        "distance": lambda a, s: {"origin": a["origin"], "destination": a["destination"], "miles": s["miles"]},
    },
    "protocol": {n: lambda a, s: {"accepted": True} for n in ("submit_order", "run_report", "plan_route", "render_asset")},
}


def execute(domain: str, name: str, arguments: dict, state: dict) -> object:
    """Result of a tool; ValueError for an unknown one, and, in productivity, for arguments that break its schema."""
    if name not in EXECUTORS.get(domain, {}):
        raise ValueError(f"unknown {domain} tool: {name}")
    if domain == "productivity":
        errors = value_errors(next(p for n, _, p in CATALOGS[domain] if n == name), arguments)
        if errors:
            raise ValueError(f"invalid arguments for {name}: {errors[0]}")
    return EXECUTORS[domain][name](arguments, state)


@vectorized("struct<result:string,error:string>")
def run_tool(domain: pd.Series, name: pd.Series, arguments: pd.Series, state: pd.Series) -> pd.DataFrame:
    """Canonical result, or an error, of each call."""
    rows = []
    for d, n, a, s in zip(domain, name, arguments, state, strict=True):
        try:
            rows.append((canonical(execute(d, n, json.loads(a), json.loads(s))), None))
        except (ValueError, KeyError) as error:
            rows.append((None, f"{type(error).__name__}: {error}"))
    return pd.DataFrame(rows, columns=["result", "error"])
