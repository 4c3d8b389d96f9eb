"""A check of exported models that needs the file only. It shares no code with the models: terms are expanded and summed here on their own."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from fractions import Fraction

VERSION = "1.0"


def digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def expanded(conditions: Sequence[dict], scale: Fraction) -> dict[frozenset, Fraction]:
    """A rule's product of terms in low and high alone, as medium is 1 - low - high."""
    out = {frozenset(): scale}
    for c in conditions:
        parts = {"low": [("low", 1)], "high": [("high", 1)], "medium": [(None, 1), ("low", -1), ("high", -1)]}[c["term"]]
        grown: dict[frozenset, Fraction] = {}
        for key, value in out.items():
            for term, sign in parts:
                more = key if term is None else key | {(c["feature"], term)}
                grown[more] = grown.get(more, Fraction(0)) + sign * value
        out = grown
    return out


def residual(certificate: dict, monomials: Sequence[Sequence]) -> list[Fraction]:
    """A g - c, exactly, in the order of the monomials."""
    place = {frozenset((f, t) for f, t in m): i for i, m in enumerate(monomials)}
    total = [-Fraction(x) for x in certificate["c_exact"]]
    gamma = [Fraction(x) for x in certificate["gamma_exact"]]
    total[place[frozenset()]] += gamma[0]
    for g, rule, scale in zip(gamma[1:], certificate["atom_rules"], certificate["atom_scales"], strict=True):
        for key, value in expanded(rule["conditions"], Fraction(scale)).items():
            total[place[key]] += g * value
    return total


def checks(artifact: dict) -> list[tuple[str, bool, str]]:
    """(name, whether it holds, what was found) for each claim of an artifact."""
    body = {k: v for k, v in artifact.items() if k != "sha256"}
    out = [("version", artifact.get("version") == VERSION, f"version {artifact.get('version')}"), ("hash", digest(body) == artifact.get("sha256"), "the artifact's hash doesn't match its content")]
    certificate = artifact.get("equality_certificate")
    if certificate is None:
        return out
    own = {k: v for k, v in certificate.items() if k != "sha256"}
    out.append(("certificate hash", digest(own) == certificate.get("sha256"), "the certificate's hash doesn't match its content"))
    if certificate["status"] == "CERTIFIED":
        try:
            wrong = [i for i, x in enumerate(residual(certificate, artifact["monomials"])) if x]
            out.append(("residual", not wrong and certificate["exact_zero_residual"], f"the residual isn't 0 at {wrong[:5]}"))
        except (KeyError, ValueError, ZeroDivisionError, IndexError) as e:
            out.append(("residual", False, f"{type(e).__name__}: {e}"))
        out.append(("coefficients", certificate["c_exact"] == artifact["coefficients"], "the certificate is of other coefficients"))
    return out


def verify_artifact(text: str) -> bool:
    """True where all claims hold; a changed or wrong artifact raises."""
    if failed := [f"{name}: {found}" for name, good, found in checks(json.loads(text)) if not good]:
        raise ValueError("; ".join(failed))
    return True


def main(args: Sequence[str] | None = None) -> int:
    """python -m tessera.plans.artifact FILE: prints each check of an exported model; the exit code is 1 where one fails."""
    import argparse

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("file")
    with open(p.parse_args(args).file, encoding="utf-8") as f:
        found = checks(json.load(f))
    for name, good, what in found:
        print(f"{name}: {'holds' if good else what}")
    return int(not all(good for _, good, _ in found))


if __name__ == "__main__":
    raise SystemExit(main())
