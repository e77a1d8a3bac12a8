"""Stand-ins for models, importable in the Python workers."""

import json


def shouting():
    """Upper case; fails for a list that holds a bad text."""

    def answer(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [t.upper() for t in texts]

    return answer


def three_numbers():
    """A unit vector for each text; fails for a list that holds a bad text."""

    def answer(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[1.0, 0.0, 0.0] for _ in texts]

    return answer


def counting(path):
    """Upper case; notes every text it is asked for in a file, and fails for bad ones while there is no file "mended"."""

    def make():
        import os

        def answer(texts):
            if len(texts) > 1:
                raise ValueError("one at a time")
            with open(f"{path}/asked", "a") as file:
                file.write(texts[0] + "\n")
            if "bad" in texts[0] and not os.path.exists(f"{path}/mended"):
                raise ValueError("bad text")
            return [t.upper() for t in texts]

        return answer

    return make


def two_each():
    """Brings two articles per batch, whatever was asked for."""

    def answer(texts):
        return [json.dumps([{"category": "Order", "issue_description": t[:9]}] * 2) for t in texts]

    return answer


def silent():
    return lambda texts: ["[]" for _ in texts]


def first_category():
    """Answers with the category of the first article in the prompt; refuses refunds."""

    def answer(texts):
        if any('"""refund' in t for t in texts):
            raise ValueError("no refunds")
        found = [t.partition("[1] Category: ")[2].partition(" > ")[0] for t in texts]
        replies = [json.dumps({"category": c, "confidence": "High"}) for c in found]
        return [f"```json\n{reply}\n```" for reply in replies]

    return answer


def strict_judge():
    return lambda texts: [
        json.dumps({"faithfulness": 1.0, "answer_relevance": 0.5, "relevance_reason": "half"})
        if "Unknown" not in t
        else "cannot judge"
        for t in texts
    ]
