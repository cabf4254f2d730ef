"""Policies by their configuration name, and the expansion of parameter grids.

An entry is ``{"name": ..., "params": [{...}, ...]}``. Numbers and flags may be strings. Nested lists (bandits of
``itembandit``, variants, factorisers, update functions) multiply out to one policy for each combination.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import product

import numpy as np

from feedloop.policies import bandits as B
from feedloop.policies import base
from feedloop.policies.base import Policy
from feedloop.policies.clusters import CLUB, COFIBA
from feedloop.policies.factors import EpsilonFactors, Factorised, GeneralisedBound, LinearBound, ThompsonFactors
from feedloop.policies.neighbours import CollaborativeGreedy, ItemKNN, UserKNN
from feedloop.policies.particles import BayesianParticleFactors, ParticleFactors, TopicRegression

ITEM_BANDITS: dict[str, type[Policy]] = {
    "epsilon": B.EpsilonGreedy, "epsilont": B.EpsilonTGreedy, "ucb1": B.UCB1, "ucb1tuned": B.UCB1Tuned, "thompson": B.Thompson,
    "delaythompson": B.DelayedThompson, "mlepop": B.CategoricalPopularity, "mleavg": B.CategoricalAverage,
}
PMF: dict[str, type[Policy]] = {"epsilon": EpsilonFactors, "ucb": LinearBound, "glmucb": GeneralisedBound, "thompson": ThompsonFactors}
#: name -> (class, fixed arguments)
POLICIES: dict[str, tuple[type[Policy], dict]] = {
    "random": (base.Random, {}), "popularity": (base.Popularity, {}), "average": (base.Average, {}), "inf-theory": (B.InformationDiversity, {}),
    "ub": (UserKNN, {}), "ub-bandit": (UserKNN, {"similarity": "beta"}), "ib": (ItemKNN, {}), "ib-bandit": (ItemKNN, {"similarity": "beta"}),
    "collab-greedy": (CollaborativeGreedy, {}), "club": (CLUB, {"graph": "complete"}), "club-erdos": (CLUB, {"graph": "erdos"}),
    "cofiba": (COFIBA, {}), "cofiba-complete": (COFIBA, {"user_graph": "complete", "item_graph": "complete"}),
    "cofiba-mixed": (COFIBA, {"user_graph": "erdos", "item_graph": "complete"}), "mf": (Factorised, {}), "pts": (ParticleFactors, {}),
    "bayesian-pts": (BayesianParticleFactors, {}), "ictr": (TopicRegression, {}), "ictr-ucb": (TopicRegression, {"gamma": 1.0}),
}
POLICIES |= {f"itembandit-{n}": (c, {}) for n, c in ITEM_BANDITS.items()} | {f"inter-pmf-{n}": (c, {}) for n, c in PMF.items()}

#: Configuration keys -> argument names.
KEYS = {
    "ignoresUnknown": "ignore_unknown", "useZeroes": "use_zeroes", "ignoreUnknown": "ignore_unknown", "ignoreZeroes": "ignore_zeroes", "userK": "k", "itemK": "item_k", "lambdaP": "lambda_p", "lambdaQ": "lambda_q",
    "sigmaQ": "sigma_q", "stdevP": "stdev_p", "stdevQ": "stdev_q", "numParticles": "particles", "numIter": "rounds", "lambda": "reg",
}


@dataclass(frozen=True)
class Spec:
    """A policy to run."""

    name: str
    policy: str
    args: dict = field(default_factory=dict, hash=False)

    def build(self, n_users: int, n_items: int, seed: int, ties: str = "random") -> Policy:
        kind, fixed = POLICIES[self.policy]
        return kind(n_users, n_items, np.random.default_rng(seed), ties=ties, **fixed, **self.args)


def _value(x):
    if isinstance(x, str):
        if x.lower() in ("true", "false"):
            return x.lower() == "true"
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                pass
    return x


def _flat(policy: str, params: dict) -> list[tuple[str, dict]]:
    """One (policy, arguments) for each combination of the nested choices."""
    nested = {k: v if isinstance(v, list) else [v] for k, v in params.items() if isinstance(v, dict) or (isinstance(v, list) and v and isinstance(v[0], dict))}
    plain = {KEYS.get(k, k): _value(v) for k, v in params.items() if k not in nested}
    choices = []
    for key, options in nested.items():
        own = []
        for option in options:
            name = option.get("name", option.get("function"))
            inner = option.get("params", [{k: v for k, v in option.items() if k not in ("name", "function")}])
            own += [(key, name, rest) for one in (inner if isinstance(inner, list) else [inner]) for _, rest in _flat("", one)]
        choices.append(own)
    out = []
    for chosen in product(*choices):
        name, args = policy, dict(plain)
        for key, option, rest in chosen:
            args |= rest
            if key.startswith("updateFunc"):
                args["step"] = option
            elif key == "factorizer":
                args["factorizer"] = option
            else:  # the bandit of an item bandit, the variant of interactive factors
                name = f"{policy}-{option}"
        if name == "itembandit-epsilont" and "alpha" in args:
            args["decay"] = args.pop("alpha")
        out.append((name, args))
    return out


def expand(entries: list[dict]) -> list[Spec]:
    """The policies of a configuration, by name; unknown names are refused."""
    out = []
    for entry in entries:
        params = entry.get("params") or [{}]
        for one in params if isinstance(params, list) else [params]:
            for policy, args in _flat(entry["name"], one):
                if policy not in POLICIES:
                    raise ValueError(f"no such policy: {policy}")
                label = "-".join([policy, *(str(v) for v in args.values())])
                out.append(Spec(label, policy, args))
    return sorted(out, key=lambda s: s.name)


def load(path: str) -> list[list[Spec]]:
    """The policies of a file: one list, or one for each split where the file has a list of lists."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return [expand(part) for part in found] if found and isinstance(found[0], list) else [expand(found)]

