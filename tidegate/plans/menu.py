"""The interactive menu: it asks for what a command needs and hands it to the command line.

An empty answer takes the default; q, end of input or Ctrl+C goes back a step, and out of the main menu.
"""

from __future__ import annotations

from collections.abc import Callable

from . import registry


class Back(Exception):
    """The user goes a step back."""


class Menu:
    """run takes a command's arguments; ask and say are input and print, or a test's."""

    def __init__(self, run: Callable[[list[str]], int], ask: Callable[[str], str] = input, say: Callable[[str], None] = print):
        self.run, self.ask, self.say = run, ask, say

    def text(self, prompt: str, default: str = "") -> str:
        try:
            got = self.ask(f"{prompt}{f' [{default}]' if default else ''}: ").strip()
        except (EOFError, KeyboardInterrupt):
            raise Back from None
        if got.lower() == "q":
            raise Back
        return got or default

    def choose(self, title: str, choices: list[str]) -> int:
        """The index of a choice, by its number or its name; asks again for anything else."""
        self.say(title)
        for i, c in enumerate(choices, 1):
            self.say(f"  {i}  {c}")
        while True:
            got = self.text("number, or q")
            if got in choices:
                return choices.index(got)
            if got.isdecimal() and 1 <= int(got) <= len(choices):
                return int(got) - 1
            self.say(f"no choice {got!r}")

    def pick(self, title: str, modes: tuple[str, ...]) -> str:
        labels = [e.label for e in registry.registry().values() if e.mode in modes]
        return labels[self.choose(title, labels)]

    def stored(self) -> list[str]:
        return ["--store", self.text("folder of the price store", "data/prices")]

    # --- flows; each gives the arguments of a command

    def ingest(self) -> list[str]:
        forced = self.text("fetch series again that are there (y/n)", "n").lower().startswith("y")
        return ["ingest", "--settings", self.text("settings", "config.toml"), *(["--force"] if forced else [])]

    def show(self) -> list[str]:
        return ["show", self.text("series", "spy:daily"), *self.stored(), "-n", self.text("rows", "10")]

    def run_one(self) -> list[str]:
        return ["run-experiment", self.pick("Experiment", ("synthetic",))]

    def run_real(self) -> list[str]:
        return ["run-real", self.pick("Experiment on real prices", ("real", "sim_to_real")), *self.stored()]

    def calibrate_scenario(self) -> list[str]:
        return ["calibrate-scenario", self.pick("Synthetic experiment to calibrate to", ("synthetic",))]

    def calibrate_asset(self) -> list[str]:
        return ["calibrate", self.text("asset", "spy"), *self.stored(), "--strategy", ("summary", "quick_em")[self.choose("Strategy", ["summary", "quick_em"])]]

    def search(self) -> list[str]:
        return ["param-search", self.pick("Experiment", ("synthetic",)), "--top", self.text("lines", "10")]

    def sim_vs_real(self) -> list[str]:
        return ["compare-sim-vs-real", self.text("folder of the simulated run"), self.text("folder of the real run")]

    def folder(self, command: str) -> list[str]:
        return [command, "--root", self.text("folder of the runs", "runs")]

    def again(self) -> list[str]:
        return ["generate-report", self.text("path of config.snapshot.json")]

    def menus(self) -> dict[str, dict[str, Callable[[], list[str]]]]:
        return {
            "Data": {"Ingest": self.ingest, "Status": lambda: ["status", *self.stored()], "Show newest rows": self.show},
            "Experiments": {"Run": self.run_one, "Run on real prices": self.run_real, "Calibrate a scenario": self.calibrate_scenario, "Calibrate to an asset": self.calibrate_asset, "Search parameters": self.search},
            "Runs": {"List": lambda: self.folder("inspect"), "Compare": lambda: self.folder("compare-runs"), "Simulated against real": self.sim_vs_real, "Run a saved one again": self.again},
            "All synthetic experiments": {"Run": lambda: self.folder("e2e")},
        }

    def loop(self) -> int:
        """Until the user leaves; a command that fails is told and doesn't end the menu."""
        menus = self.menus()
        names = [*menus, "Exit"]
        while True:
            try:
                at = self.choose("Main menu", names)
            except Back:
                return 0
            if names[at] == "Exit":
                return 0
            flows = menus[names[at]]
            try:
                flow = list(flows.values())[self.choose(names[at], list(flows)) if len(flows) > 1 else 0]
                self.run(flow())
            except Back:
                continue
            except (Exception, SystemExit) as e:  # noqa: BLE001  whatever a command raises is told
                self.say(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
