"""Small tables for the tests."""

from __future__ import annotations

import json

KB_SCHEMA = "pos long, id string, city_code string, city_name string, kind string, name string, text string, source_title string, source_url string, verified_on string"


def kb_rows():
    site = "https://example.org/"
    return [
        (0, "f1", "370000", "甲市", "food", "面", "本地面食", "旧题", site + "a", "2024-01-01"),
        (1, "s1", "370000", "甲市", "sight", "塔", "古塔临河", "塔", site + "b", "2024-05-01"),
        (2, "f2", "370000", "甲市", "food", "饼", "烤饼", "新题", site + "a", "2024-03-01"),
        (3, "f3", "420000", "乙市", "food", "鱼", "江鱼", "鱼", site + "c", "2024-02-01"),
    ], KB_SCHEMA


def decision_text(scene: str = "chat", goal: str = "拒绝", **more) -> str:
    value = {"scene": scene, "intent": "rewrite" if scene == "chat" else "none", "complexity": 0.5, "confidence": 0.9, "need_cloud": False, "slots": {"target_tone": "自然", "goal": goal} if scene == "chat" else {}}
    return json.dumps(value | more, ensure_ascii=False)
