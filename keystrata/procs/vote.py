"""Votes: topics with options; one active ballot for each user and vote."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions.types import EngineError
from keystrata.plans.engine import Session

NAME = "vote"
#: Table schemas. Fixed values.
DDL = """
CREATE TABLE vote_users (user_id TEXT PRIMARY KEY, phone TEXT);
CREATE TABLE votes (vote_id TEXT PRIMARY KEY, creator_id TEXT, topic TEXT NOT NULL, vote_type TEXT, max_choices INTEGER, end_time INTEGER NOT NULL, visibility_rule TEXT);
CREATE TABLE options (option_id TEXT PRIMARY KEY, vote_id TEXT, option_text TEXT NOT NULL);
CREATE TABLE vote_actions (action_id TEXT PRIMARY KEY, user_id TEXT, vote_id TEXT, action_time INTEGER NOT NULL, is_withdrawn INTEGER);
CREATE TABLE vote_choices (choice_id TEXT PRIMARY KEY, action_id TEXT, option_id TEXT);
"""


def _now() -> int:
    return int(time.time())


def _id() -> str:
    return str(uuid.uuid4())


def create_user(s: Session, phone: str) -> str:
    user = _id()
    s.execute("INSERT INTO vote_users (user_id, phone) VALUES (?, ?)", (user, phone))
    return user


def create_vote(s: Session, creator: str, topic: str, vote_type: str, max_choices: int, end_time: int, visibility: str) -> str:
    checks = [(end_time > _now(), "the end must be in the future"), (vote_type in ("single", "multiple"), "single or multiple"), (vote_type != "single" or max_choices == 1, "a single vote has one choice"), (visibility in ("always", "after_end"), "always or after_end")]
    for ok, message in checks:
        if not ok:
            raise EngineError("invalid_argument", message)
    vote = _id()
    s.execute("INSERT INTO votes (vote_id, creator_id, topic, vote_type, max_choices, end_time, visibility_rule) VALUES (?, ?, ?, ?, ?, ?, ?)", (vote, creator, topic, vote_type, max_choices, end_time, visibility))
    return vote


def add_option(s: Session, vote: str, text: str) -> str:
    option = _id()
    s.execute("INSERT INTO options (option_id, vote_id, option_text) VALUES (?, ?, ?)", (option, vote, text))
    return option


def _vote(s: Session, vote: str):
    row = s.one("SELECT * FROM votes WHERE vote_id = ?", (vote,))
    if row is None:
        raise EngineError("not_found", f"vote {vote}")
    return row


def _active(s: Session, user: str, vote: str):
    return s.one("SELECT * FROM vote_actions WHERE user_id = ? AND vote_id = ? AND is_withdrawn = 0", (user, vote))


def cast_vote(s: Session, user: str, vote: str, options: list[str]) -> str:
    v = _vote(s, vote)
    if _now() > v.end_time:
        raise EngineError("invalid_state", "voting has ended")
    if _active(s, user, vote):
        raise EngineError("invalid_state", "there is an active ballot")
    if (v.vote_type == "single" and len(options) != 1) or not 0 < len(options) <= max(1, v.max_choices):
        raise EngineError("invalid_argument", "number of choices")
    action = _id()
    s.execute("INSERT INTO vote_actions (action_id, user_id, vote_id, action_time, is_withdrawn) VALUES (?, ?, ?, ?, ?)", (action, user, vote, _now(), 0))
    for o in options:
        s.execute("INSERT INTO vote_choices (choice_id, action_id, option_id) VALUES (?, ?, ?)", (_id(), action, o))
    return action


def withdraw_vote(s: Session, user: str, vote: str) -> None:
    if _now() > _vote(s, vote).end_time:
        raise EngineError("invalid_state", "voting has ended")
    action = _active(s, user, vote)
    if action is None:
        raise EngineError("not_found", "no active ballot")
    s.execute("UPDATE vote_actions SET is_withdrawn = 1 WHERE action_id = ?", (action.action_id,))


def results(choices: DataFrame, actions: DataFrame) -> DataFrame:
    """Ballots of every (vote, option), withdrawn ones left out: one join and one aggregate for all votes."""
    live = actions.where("is_withdrawn = 0").select("action_id", "vote_id")
    return choices.join(live, "action_id").groupBy("vote_id", "option_id").agg(F.count(F.lit(1)).alias("n"))


def get_vote_result(s: Session, vote: str) -> dict:
    v = _vote(s, vote)
    ended = _now() > v.end_time
    if v.visibility_rule == "after_end" and not ended:
        raise EngineError("invalid_state", "results are visible after the end")
    total = s.one("SELECT COUNT(*) AS n FROM vote_actions WHERE vote_id = ? AND is_withdrawn = 0", (vote,)).n
    counts = {r.option_id: r.n for r in results(s.table("vote_choices"), s.table("vote_actions").where(F.col("vote_id") == vote)).collect()}
    options = {r.option_id: counts.get(r.option_id, 0) for r in s.query("SELECT option_id FROM options WHERE vote_id = ?", (vote,)).collect()}
    return {"vote_id": vote, "topic": v.topic, "vote_ended": ended, "total_votes": total, "options": options}


def get_voting_history(s: Session, user: str) -> list[dict]:
    rows = s.query("SELECT va.*, v.topic, v.end_time FROM vote_actions va JOIN votes v ON va.vote_id = v.vote_id WHERE va.user_id = ? ORDER BY va.action_time, va.action_id", (user,)).collect()
    return [{"vote_id": r.vote_id, "topic": r.topic, "action_time": r.action_time, "is_withdrawn": r.is_withdrawn, "vote_ended": _now() > r.end_time} for r in rows]


PROCEDURES = {f.__name__: f for f in (create_user, create_vote, add_option, cast_vote, withdraw_vote, get_vote_result, get_voting_history)}
