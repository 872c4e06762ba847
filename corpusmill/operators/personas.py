"""Synthetic personas: dated sessions of turns with annotations, and questions with evidence.

Each persona draws from a generator seeded by the seed and its own id, so ids can be made anywhere in any order.  The
wording and value pools are a specification of the caller's (a small one is given); a split may add held-out wordings.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from corpusmill.sources.files import PERSONA

ABSTAIN = "你沒有提過"
LETTERS = "ABCD"
#: attribute -> (label, values, what is said, what is said on a change or nothing, what is asked, what is said of others)
SPEC: dict[str, tuple] = {
    "city": ("居住地", [f"{x}鎮" for x in "東西南北中上下新"], "我家在{v}。", "我搬到{v}了。", "我現在住哪個鎮？", "{w}家在{v}。"),
    "drink": ("飲料", ["紅茶", "綠茶", "咖啡", "豆漿", "果汁", "牛奶"], "我每天早上喝{v}。", "我改喝{v}了。", "我早上喝什麼？", "{w}早上喝{v}。"),
    "color": ("顏色", ["藍色", "綠色", "黃色", "紫色", "白色", "黑色"], "我最常穿{v}。", None, "我常穿什麼顏色？", "{w}常穿{v}。"),
    "hobby": ("嗜好", ["爬山", "釣魚", "畫畫", "下棋", "唱歌", "烘焙"], "我週末都去{v}。", None, "我週末做什麼？", "{w}週末去{v}。"),
    "rent": ("房租", [f"{n}元" for n in range(8000, 20000, 500)], "我的房租是{v}。", "房東把房租改成{v}。", "我的房租多少？", "{w}的房租是{v}。"),
}
OTHERS = ["我朋友", "我同事", "我鄰居"]
NOISE = [f"今天{a}{b}。" for a in ("天氣", "路上", "午餐", "電視", "公車") for b in ("還不錯", "普普通通", "有點無聊", "讓人意外")]


def _worded(rng: np.random.Generator, public: str, held_out: tuple = (), chance: float = 0.0) -> str:
    """A public wording or, with a chance, one of those held out for a split."""
    return held_out[int(rng.integers(len(held_out)))] if held_out and rng.random() < chance else public


def _pick(rng: np.random.Generator, pool: list, without: tuple = ()):
    rest = [x for x in pool if x not in without]
    return rest[int(rng.integers(len(rest)))]


def persona(pid: str, rng: np.random.Generator, spec: dict = SPEC, sessions: int = 4, turns: int = 8, questions: int = 10, forced: tuple[str, ...] = (), held_out: dict[str, tuple[str, ...]] | None = None, chance: float = 0.0) -> dict:
    """One persona; every question has four distinct options, and evidence points at the turn that answers it.

    forced: attributes that every persona has; held_out: further wordings of statements by attribute, used with `chance`.
    """
    names = list(spec)
    rest = [names[i] for i in rng.permutation(len(names)).tolist() if names[i] not in forced]
    owned = sorted([*forced, *rest][: max(2, len(names) - 1, len(forced))], key=names.index)
    missing = [k for k in names if k not in owned]
    plan: list[list[tuple[str, str, str, str]]] = [[] for _ in range(sessions)]  # text, type, key, value
    now: dict[str, str] = {}
    for k in owned:
        label, pool, said, changed, _, other = spec[k]
        at = int(rng.integers(0, sessions - 1))
        now[k] = _pick(rng, pool)
        plan[at].append((_worded(rng, said, (held_out or {}).get(k, ()), chance).format(v=now[k]), "fact", k, now[k]))
        if changed and rng.random() < 0.5:
            # a change always comes in a later session
            now[k] = _pick(rng, pool, (now[k],))
            plan[int(rng.integers(at + 1, sessions))].append((changed.format(v=now[k]), "update", k, now[k]))
        if rng.random() < 0.7:
            v = _pick(rng, pool, (now[k],))
            plan[at].append((other.format(w=_pick(rng, OTHERS), v=v), "other", k, v))
    fresh = [NOISE[i] for i in rng.permutation(len(NOISE)).tolist()]
    day = np.datetime64("2024-01-01") + int(rng.integers(0, 60))
    out, where = [], {}
    for s, events in enumerate(plan):
        free = max(0, turns - len(events))
        rows = [(x, None, None, None) for x in (fresh[(s * turns + i) % len(fresh)] for i in range(free))] + events
        rows = [rows[i] for i in rng.permutation(len(rows)).tolist()]
        for t, (_, kind, key, _) in enumerate(rows):
            if kind in ("fact", "update"):
                where[key] = (s, t)
        out.append({"session_id": s, "date": str(day), "turns": [r[0] for r in rows], "annotations": [{"turn": t, "type": r[1], "key": spec[r[2]][0], "value": r[3]} for t, r in enumerate(rows) if r[1]]})
        day += int(rng.integers(2, 21))
    asked = []
    for n in range(questions):
        slot = n % 4
        unknown = missing and n % 5 == 4
        k = missing[n % len(missing)] if unknown else owned[n % len(owned)]
        label, pool, _, _, ask, _ = spec[k]
        right = ABSTAIN if unknown else now[k]
        wrong = [pool[i] for i in rng.permutation(len(pool)).tolist() if pool[i] != right][: 3 if unknown else 2] + ([] if unknown else [ABSTAIN])
        options = wrong[:slot] + [right] + wrong[slot:]
        asked.append({"qid": f"{pid}q{n:02d}", "type": "abstain" if unknown else "single", "question": ask, "options": dict(zip(LETTERS, options)), "answer": LETTERS[slot], "keys": [label], "evidence": [] if unknown else [list(where[k])]})
    return {"persona_id": pid, "profile": {spec[k][0]: v for k, v in now.items()}, "sessions": out, "questions": asked}


#: kind of tool item -> how often, of a hundred.  Fixed values.
TOOL_KINDS = {"save": 28, "update": 10, "search": 22, "search_calc": 6, "calculator": 12, "date": 6, "answer_noise": 10, "answer_other": 6}
TOOL = "id string, kind string, context array<string>, expected string"
#: What is asked for a sum, with two numbers, and the expression and value it comes to.
SUMS = (("{a}加{b}是多少？", "{a}+{b}", lambda a, b: a + b), ("{a}乘以{b}等於多少？", "{a}*{b}", lambda a, b: a * b), ("{a}減{b}剩多少？", "{a}-{b}", lambda a, b: a - b))
DATES = ("今天是幾月幾號？", "今天星期幾？")


def tool_item(tid: str, rng: np.random.Generator, spec: dict = SPEC) -> dict:
    """One item: what was said, and the call or the plain answer that is right for it."""
    kind = str(rng.choice(list(TOOL_KINDS), p=np.array(list(TOOL_KINDS.values())) / sum(TOOL_KINDS.values())))
    changing = [k for k, x in spec.items() if x[3]]
    key = _pick(rng, changing if kind == "update" else list(spec))
    label, pool, said, changed, asked, other = spec[key]
    value = _pick(rng, pool)
    before = [_pick(rng, NOISE) for _ in range(int(rng.integers(0, 3)))]
    call = lambda tool, args, accept: {"action": "call", "tool": tool, "args": args, "accept": accept}
    saved = lambda v: call("memory_save", {"key": label, "value": v}, {"key": [label], "value": [v]})
    if kind == "save":
        last, expected = said.format(v=value), saved(value)
    elif kind == "update":
        before = [said.format(v=_pick(rng, pool, (value,))), *before]
        last, expected = changed.format(v=value), saved(value)
    elif kind == "search":
        last, expected = asked, call("memory_search", {"query": label}, {"query": [label]})
    elif kind == "search_calc":
        last, expected = "我一年的房租多少？", call("memory_search", {"query": spec["rent"][0]}, {"query": [spec["rent"][0]]}) if "rent" in spec else call("memory_search", {"query": label}, {"query": [label]})
    elif kind == "calculator":
        text, expression, worth = SUMS[int(rng.integers(len(SUMS)))]
        a, b = (int(x) for x in rng.integers(2, 500, 2))
        last, expected = text.format(a=a, b=b), call("calculator", {"expression": expression.format(a=a, b=b)}, {"value": worth(a, b)})
    elif kind == "date":
        last, expected = _pick(rng, list(DATES)), call("get_date", {}, {})
    else:
        last = _pick(rng, NOISE) if kind == "answer_noise" else other.format(w=_pick(rng, OTHERS), v=value)
        expected = {"action": "answer"}
    return {"id": tid, "kind": kind, "context": [*before, last], "expected": json.dumps(expected, ensure_ascii=False)}


def _seeded(spark: SparkSession, n: int, seed: int, prefix: str, one, schema: str) -> DataFrame:
    """n rows of one(id, generator); the same rows whatever the partitions."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i in batch["id"]:
                name = f"{prefix}{i:04d}"
                own = int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "little")
                rows.append(one(name, np.random.default_rng(own)))
            yield pd.DataFrame(rows)

    return spark.range(n).mapInPandas(make, schema)


def generate(spark: SparkSession, n: int, seed: int, split: str = "train", spec: dict = SPEC, sessions: int = 4, turns: int = 8, forced: tuple[str, ...] = (), held_out: dict[str, tuple[str, ...]] | None = None, chance: float = 0.0) -> DataFrame:
    """n personas, ids like trp0001."""
    return _seeded(spark, n, seed, f"{split[:2]}p", lambda pid, rng: persona(pid, rng, spec, sessions, turns, forced=forced, held_out=held_out, chance=chance), PERSONA)


def generate_tools(spark: SparkSession, n: int, seed: int, split: str = "train", spec: dict = SPEC) -> DataFrame:
    """n tool items, ids like trt0001."""
    return _seeded(spark, n, seed, f"{split[:2]}t", lambda tid, rng: tool_item(tid, rng, spec), TOOL)
