"""``python -m matchloom --stage all``"""

from __future__ import annotations

import argparse
import json

from .config import load
from .plans.linkage import STAGES, run
from .session import session


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="matchloom")
    parser.add_argument("--stage", choices=["all", *STAGES], default="all")
    parser.add_argument("--sample", type=int, help="entities to train on or evaluate")
    parser.add_argument("--config", help="a TOML file")
    chosen = parser.parse_args(arguments)
    stages = STAGES if chosen.stage == "all" else [chosen.stage]
    print(json.dumps(run(session(), load(chosen.config), stages, chosen.sample), indent=1, default=str))


if __name__ == "__main__":
    main()
