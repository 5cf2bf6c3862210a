"""Users and question sets from TOML, checked as frames: all that is wrong is reported, and nothing half-valid is used."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import re
import secrets
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.text import contains_normalized, normalize
from skarn.operators import phrases
from skarn.operators.segments import Snapshot
from skarn.settings import DEFAULT, Settings

# The fields of a user and of a question.
USER_FIELDS = ("username", "name", "role", "password")
QUESTION_FIELDS = ("id", "type", "role", "question", "expected", "answerable", "sources", "evidence", "must_include", "any_of", "must_not", "forbidden", "history", "known_gap", "off_topic")
REQUIRED = ("id", "type", "role", "question", "expected")
LISTS = ("sources", "must_include", "any_of", "must_not", "forbidden", "history")
QUESTION_SCHEMA = (
    "question_id int, type string, role string, question string, expected string, answerable boolean, off_topic boolean, known_gap string, evidence array<array<string>>, "
    + ", ".join(f"{c} array<string>" for c in LISTS)
)


class ConfigError(ValueError):
    """A configuration file breaks a rule."""


def _load(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"not valid TOML: {e}") from e


def _phrases(x) -> bool:
    return isinstance(x, list) and all(isinstance(p, str) and p.strip() for p in x)


def _question_faults(q: dict, s: Settings) -> list[str]:
    """What is wrong with one question as it stands in the file."""
    good_evidence = isinstance(q.get("evidence", []), list) and all(_phrases(e if isinstance(e, list) else [e]) and e for e in q.get("evidence", []))
    answerable, off_topic = q.get("answerable", True), q.get("off_topic", False)
    rules = {
        f"unknown fields {sorted(set(q) - set(QUESTION_FIELDS))}": set(q) - set(QUESTION_FIELDS),
        f"missing fields {sorted(set(REQUIRED) - set(q))}": set(REQUIRED) - set(q),
        "id is no number": "id" in q and type(q["id"]) is not int,
        "empty text": any(k in q and (not isinstance(q[k], str) or not q[k].strip()) for k in REQUIRED[1:]),
        "unknown role": "role" in q and q["role"] not in s.roles,
        "answerable and off_topic are true or false": not isinstance(answerable, bool) or not isinstance(off_topic, bool),
        "known_gap is no text": not isinstance(q.get("known_gap", ""), str),
        "off-topic and answerable": off_topic is True and answerable is True,
        "lists hold non-empty texts": not all(_phrases(q.get(k, [])) for k in LISTS) or not good_evidence,
        "answerable without sources": answerable is True and not q.get("sources"),
        "unanswerable with sources or evidence": answerable is False and (q.get("sources") or q.get("evidence")),
    }
    return [rule for rule, broken in rules.items() if broken]


def questions(spark: SparkSession, text: str, s: Settings = DEFAULT) -> DataFrame:
    """The checked question set; unanswerable questions without phrases of their own take the file's not-found phrases."""
    data = _load(text)
    items, default = data.get("question", []), data.get("not_found_phrases", [])
    if set(data) - {"question", "not_found_phrases"} or not isinstance(items, list) or not items or not _phrases(default):
        raise ConfigError("questions stand under [[question]], beside not_found_phrases alone")
    faults = [f"question {i}: {f}" for i, q in enumerate(items, 1) for f in _question_faults(q, s)]
    ids = [q.get("id") for q in items]
    faults += [f"id {i} is used {ids.count(i)} times" for i in dict.fromkeys(ids) if ids.count(i) > 1]
    if faults:
        raise ConfigError("; ".join(faults))
    rows = []
    for q in items:
        ok = q.get("answerable", True)
        lists = {k: q.get(k, []) for k in LISTS} | ({} if ok or q.get("any_of") else {"any_of": default})
        rows.append((q["id"], q["type"], q["role"], q["question"], q["expected"], ok, q.get("off_topic", False), q.get("known_gap"), [e if isinstance(e, list) else [e] for e in q.get("evidence", [])], *(lists[k] for k in LISTS)))
    return spark.createDataFrame(rows, QUESTION_SCHEMA)


def against_index(asked: DataFrame, chunks: DataFrame | Snapshot) -> DataFrame:
    """(question_id, problem, blocking): expected files that are not indexed, and evidence in none of their chunks.

    In a snapshot, phrases are looked up by the positions of their words; each different one once, in whatever files. Chunks
    that are not indexed are searched one by one. Evidence that a known gap lacks is a finding and does not block a run."""
    indexed = isinstance(chunks, Snapshot)
    wanted = asked.select("question_id", "known_gap", F.explode("sources").alias("source"))
    gone = wanted.join((chunks.docs if indexed else chunks).select("source").distinct(), "source", "left_anti").select("question_id", F.concat("source", F.lit(" is not indexed")).alias("problem"), F.lit(True).alias("blocking"))
    facts = asked.select("question_id", "known_gap", "sources", F.posexplode("evidence").alias("fact", "phrases"))
    each = facts.select("question_id", "fact", "sources", F.explode("phrases").alias("phrase")).withColumn("phrase_id", F.xxhash64("phrase"))
    if indexed:
        found = phrases.holding(chunks, each.select("phrase_id", "phrase").distinct(), "source").select("phrase_id", "source").distinct()
    else:
        near = each.select("phrase_id", normalize(F.col("phrase")).alias("p"), F.explode("sources").alias("source")).distinct()
        both = near.join(chunks.select("source", normalize(F.col("text")).alias("t")), "source")
        found = both.where(contains_normalized(F.col("t"), F.col("p"))).select("phrase_id", "source").distinct()
    held = each.select("question_id", "fact", "phrase_id", F.explode("sources").alias("source")).join(found, ["phrase_id", "source"]).select("question_id", "fact").distinct()
    lost = facts.join(held, ["question_id", "fact"], "left_anti").select("question_id", F.concat(F.lit("no chunk holds "), F.array_join("phrases", " / ")).alias("problem"), F.col("known_gap").isNull().alias("blocking"))
    return gone.unionByName(lost)


# --- users: small files that the driver reads and writes


def hash_password(password: str, salt: bytes | None = None) -> str:
    if len(password) < 10:
        raise ConfigError("a password has ten characters or more")
    salt = salt or secrets.token_bytes(16)
    return f"scrypt${salt.hex()}${hashlib.scrypt(password.encode(), salt=salt, n=2**14, r=8, p=1).hex()}"


def password_fits(password: str, stored: str) -> bool:
    kind, salt, want = (stored.split("$") + ["", ""])[:3]
    got = hashlib.scrypt(password.encode(), salt=bytes.fromhex(salt) if kind == "scrypt" else b"-", n=2**14, r=8, p=1).hex()
    return hmac.compare_digest(got, want) and kind == "scrypt"


def load_users(path: str, s: Settings = DEFAULT) -> dict[str, dict]:
    """User name -> fields; no file, no users."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        items = _load(f.read()).get("user", [])
    out: dict[str, dict] = {}
    for i, u in enumerate(items, 1):
        if set(u) != set(USER_FIELDS) or not re.fullmatch(r"[a-z0-9][a-z0-9._-]*", str(u["username"])) or u["role"] not in s.roles or u["username"] in out:
            raise ConfigError(f"user {i} has wrong fields, a bad or repeated name, or an unknown role")
        out[u["username"]] = u
    return out


def save_users(users: dict[str, dict], path: str) -> None:
    """Writes the whole file beside the old one and puts it in its place."""
    text = "\n".join("[[user]]\n" + "".join(f"{k} = {json.dumps(users[n][k], ensure_ascii=False)}\n" for k in USER_FIELDS) for n in sorted(users))
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.new", path)


def authenticated(path: str, username: str, password: str, s: Settings = DEFAULT) -> dict | None:
    """The user, or None; an unknown name costs as much time as a wrong password."""
    user = load_users(path, s).get(username.strip().lower())
    fits = password_fits(password, user["password"] if user else "none$$")
    return user if user and fits else None


def is_admin(role, admin_role: str = "hr_admin"):
    """Whether a user of this role (a column) may change the index and the users."""
    return F.coalesce(role == admin_role, F.lit(False))


def admins_left(users: dict[str, dict], without: str, admin_role: str = "hr_admin") -> int:
    return sum(u["role"] == admin_role and n != without for n, u in users.items())


def add_catalog_entry(spark: SparkSession, path: str, entry: str) -> None:
    """Appends an entry to a catalog file; a catalog that is then unsound is put back as it was."""
    from skarn.operators.catalog import checked, parsed

    with open(path, encoding="utf-8") as f:
        before = f.read()
    after = before.rstrip("\n") + "\n\n" + entry
    checked(parsed(spark, after))
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(after)
    os.replace(f"{path}.new", path)
