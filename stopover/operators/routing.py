"""Where a post of a conversation belongs: rule tables over what one post shows against the topics so far.

The state of a conversation is a few matrices and sets, never its texts. A router is a table of rules, tried in order: each has
a reason, a test of the post's :class:`Sight`, and a move.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

import numpy as np

from stopover.functions.text import NGRAM_DIM, gram_bucket

OFF = "OFF"


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n else v


class Contexts:
    """Topics of one conversation: a row of 2-gram counts of all texts joined by a full stop, and one of summed unit vectors."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.joined, self.units = np.zeros((4, NGRAM_DIM)), np.zeros((4, NGRAM_DIM))
        self.tail: list[str] = []
        self.lone: list[np.ndarray | None] = []  # counts of a first post too short to have a 2-gram: void once texts are joined
        self.nouns: list[set[str]] = []
        self.gold: list[Counter] = []

    def add(self, topic: str, post: dict) -> None:
        counts, at = np.asarray(post["counts"]), self.row.get(topic)
        short = post["chars"] <= 1
        if at is None:
            at = self.row[topic] = len(self.tail)
            if at == len(self.joined):
                self.joined, self.units = (np.concatenate([m, np.zeros_like(m)]) for m in (self.joined, self.units))
            self.tail.append("")
            self.lone.append(counts if short else None)
            self.nouns.append(set())
            self.gold.append(Counter())
            self.joined[at] += counts
        else:
            if self.lone[at] is not None:
                self.joined[at] -= self.lone[at]
                self.lone[at] = None
            self.joined[at, gram_bucket(self.tail[at] + "。")] += 1.0
            self.joined[at, gram_bucket("。" + post["head"])] += 1.0
            if not short:
                self.joined[at] += counts
        self.units[at] += unit(counts)
        self.tail[at] = post["tail"]
        self.nouns[at].update(post["nouns"])
        self.gold[at][first_topic(post)] += 1

    def drop(self, topic: str) -> None:
        del self.row[topic]

    def likeness(self, vector: np.ndarray, ctx: str) -> dict[str, float]:
        """Cosine of a unit vector to every topic's context."""
        if not self.row:
            return {}
        held = self.units if ctx == "mean" else self.joined
        rows = held[list(self.row.values())]
        norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        dots = np.einsum("ij,j->i", rows, vector)  # no threads of its own beside the other tasks
        return dict(zip(self.row, (dots / np.where(norm > 0, norm, 1.0)).tolist(), strict=True))

    def sharing(self, nouns: set[str]) -> set[str]:
        return {t for t, at in self.row.items() if nouns & self.nouns[at]}

    def fresh(self, nouns: set[str]) -> int:
        """Nouns that no topic has held."""
        return len(nouns.difference(*(self.nouns[at] for at in self.row.values())))


def first_topic(post: dict) -> str:
    return post["topics"][0] if len(post["topics"]) else OFF


@dataclass
class Talk:
    """One conversation under one setting: placements, topics, posts that wait for an answer and topics still tentative."""

    setting: dict
    contexts: Contexts = field(default_factory=Contexts)
    place: dict[str, str | None] = field(default_factory=dict)  # None: waits
    waiting: dict[str, dict] = field(default_factory=dict)
    tentative: dict[str, tuple[dict, dict]] = field(default_factory=dict)  # topic: its row and its post
    opened: int = 0

    def open(self) -> str:
        self.opened += 1
        return f"t{self.opened}"

    def put(self, post: dict, topic: str, reason: str, deferred: bool = False) -> dict:
        self.place[post["post_id"]] = topic
        if topic != OFF:
            self.contexts.add(topic, post)
        return {"post_id": post["post_id"], "assign": topic, "reason": reason, "deferred": deferred}

    def ask(self, post: dict, topic: str, reason: str) -> dict:
        """A post that the rules leave open: as the gold has it if the setting may ask, else at the fallback."""
        return self.put(post, self.answer(post) if self.setting["oracle"] else topic, reason, True)

    def answer(self, post: dict) -> str:
        """The topic whose posts mostly are of the post's gold topic, or a new one."""
        wanted = first_topic(post)
        if wanted == OFF:
            return OFF
        fits = (t for t, at in self.contexts.row.items() if self.contexts.gold[at].most_common(1)[0][0] == wanted)
        return next(fits, None) or self.open()

    def firm(self, topic: str) -> list[dict]:
        """A tentative topic that gets a second post or a reply: its first post can be published."""
        return [self.tentative.pop(topic)[0]] if topic in self.tentative else []


class Sight:
    """What the rules look at: one post against its conversation, each part worked out when a rule asks for it."""

    def __init__(self, talk: Talk, post: dict, replies: list[str]):
        self.talk, self.post, self.setting = talk, post, talk.setting
        self.targets = [t for t in replies if t in talk.place]

    @cached_property
    def open_targets(self) -> list[str]:
        return [t for t in self.targets if self.talk.place[t] is None]

    @cached_property
    def homes(self) -> list[str]:
        return [self.talk.place[t] for t in self.targets if self.talk.place[t] not in (OFF, None)]

    @cached_property
    def nouns(self) -> set[str]:
        return set(self.post["nouns"])

    @cached_property
    def shared(self) -> set[str]:
        return self.talk.contexts.sharing(self.nouns)

    @cached_property
    def likeness(self) -> dict[str, float]:
        return self.talk.contexts.likeness(self.post["vector"], self.setting["ctx"])

    @cached_property
    def ranked(self) -> list[tuple[float, str]]:
        return sorted(((s, t) for t, s in self.likeness.items()), reverse=True)

    @property
    def nearest(self) -> str:
        return self.ranked[0][1]

    @property
    def lead(self) -> float:
        """How much the nearest topic is ahead of the next one."""
        return self.ranked[0][0] - (self.ranked[1][0] if len(self.ranked) > 1 else -1.0)

    @cached_property
    def home(self) -> str:
        """The nearest of the topics that are replied to."""
        return max((self.likeness[t], t) for t in self.homes)[1]

    @property
    def home_gap(self) -> float:
        return self.ranked[0][0] - self.likeness[self.home]

    @property
    def alien(self) -> bool:
        """Like no topic so far."""
        return not self.ranked or self.ranked[0][0] < self.setting["th_new"]


class Rule(NamedTuple):
    reason: str
    test: Callable[[Sight], object]
    move: Callable[[Sight, str], list[dict]]


def _put(where: Callable[[Sight], str]) -> Callable[[Sight, str], list[dict]]:
    return lambda s, reason: [s.talk.put(s.post, where(s), reason)]


def _ask(where: Callable[[Sight], str]) -> Callable[[Sight, str], list[dict]]:
    return lambda s, reason: [s.talk.ask(s.post, where(s), reason)]


def _answered(s: Sight, reason: str) -> list[dict]:
    """Waiting posts and the reply to them open a topic; the waiting ones count as deferred."""
    talk = s.talk
    posts = [talk.waiting.pop(t) for t in s.open_targets]
    if s.setting["oracle"]:
        return [talk.ask(p, OFF, "pending, answered") for p in posts] + [talk.ask(s.post, OFF, reason)]
    topic = talk.open()
    return [talk.put(p, topic, "pending, answered", True) for p in posts] + [talk.put(s.post, topic, reason)]


def _wait(s: Sight, reason: str) -> list[dict]:
    s.talk.place[s.post["post_id"]] = None
    s.talk.waiting[s.post["post_id"]] = s.post
    return []


V1 = [
    Rule("answer to pending", lambda s: s.open_targets, _answered),
    Rule("target off topic", lambda s: s.targets and not s.homes, _put(lambda s: OFF)),
    Rule("acknowledgement", lambda s: s.targets and s.post["is_ack"], _put(lambda s: s.homes[0])),
    Rule("branch", lambda s: s.targets and s.setting["branch_k"] and s.talk.contexts.fresh(s.nouns) >= s.setting["branch_k"], _ask(lambda s: s.homes[0])),
    Rule("reply", lambda s: s.targets and (s.nearest in s.homes or s.home_gap < s.setting["delta"]), _put(lambda s: s.home)),
    Rule("another topic is closer", lambda s: s.targets, _ask(lambda s: s.nearest)),
    Rule("first post", lambda s: not s.talk.contexts.row, _put(lambda s: s.talk.open())),
    Rule("waits", lambda s: s.post["is_question"] or not s.shared, _wait),
    Rule("vector and noun", lambda s: s.lead >= s.setting["delta"] and s.nearest in s.shared, _put(lambda s: s.nearest)),
    Rule("small lead", lambda s: True, _ask(lambda s: s.nearest)),
]


def v1_end(talk: Talk) -> list[dict]:
    """Posts that nobody answered go where a noun of theirs points, else off topic."""
    seen = [Sight(talk, p, []) for p in talk.waiting.values()]
    rows = []
    for s in seen:  # each is seen after the one before has been placed
        rows.append(talk.ask(s.post, s.nearest if s.shared else OFF, "pending at the end"))
    return rows


def _firmly(move: Callable[[Sight, str], list[dict]]) -> Callable[[Sight, str], list[dict]]:
    """The move, and before its row that of a tentative topic which it makes firm."""
    def both(s: Sight, reason: str) -> list[dict]:
        rows = move(s, reason)
        return [*s.talk.firm(rows[-1]["assign"]), *rows]

    return both


def _replied(move: Callable[[Sight, str], list[dict]]) -> Callable[[Sight, str], list[dict]]:
    """The move of a reply, which makes the topic it replies to firm first."""
    return lambda s, reason: [*s.talk.firm(s.homes[0]), *move(s, reason)]


def _branch(s: Sight, reason: str) -> list[dict]:
    """A reply unlike its topic: deferred to the gold, else to a new topic or the nearest one."""
    if s.setting["oracle"]:
        return _firmly(_ask(lambda s: OFF))(s, reason)
    if s.alien:
        return [s.talk.put(s.post, s.talk.open(), reason, True)]
    return _firmly(lambda s, reason: [s.talk.put(s.post, s.nearest, reason, True)])(s, reason)


def _tentative(s: Sight, reason: str) -> list[dict]:
    row = s.talk.put(s.post, s.talk.open(), reason)
    s.talk.tentative[row["assign"]] = (row, s.post)
    return []


V2 = [
    Rule("target off topic", lambda s: s.targets and not s.homes, _put(lambda s: OFF)),
    Rule("acknowledgement", lambda s: s.targets and s.post["is_ack"], _replied(_put(lambda s: s.homes[0]))),
    Rule("reply", lambda s: s.targets and s.likeness[s.homes[0]] >= s.setting["th_branch"], _replied(_put(lambda s: s.homes[0]))),
    Rule("branch", lambda s: s.targets, _replied(_branch)),
    Rule("small talk", lambda s: s.post["is_ack"], _put(lambda s: OFF)),
    Rule("new topic", lambda s: s.alien, _tentative),
    Rule("small lead", lambda s: s.lead < s.setting["delta"], _firmly(_ask(lambda s: s.nearest))),
    Rule("vector", lambda s: True, _firmly(_put(lambda s: s.nearest))),
]


def v2_end(talk: Talk) -> list[dict]:
    """Topics still tentative hold one post, which is deferred."""
    rows = []
    for topic, (row, post) in list(talk.tentative.items()):
        reason = f"{row['reason']}, alone at the end"
        if talk.setting["oracle"]:
            talk.contexts.drop(topic)
            rows.append(talk.ask(post, OFF, reason))
        else:
            rows.append({**row, "reason": reason, "deferred": True})
    return rows


def decide(rules: list[Rule], talk: Talk, post: dict, replies: list[str]) -> list[dict]:
    """Rows that the first rule that fits gives."""
    sight = Sight(talk, post, replies)
    rule = next(r for r in rules if r.test(sight))
    return rule.move(sight, rule.reason)
