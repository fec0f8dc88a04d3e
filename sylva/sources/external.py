"""Adapters to external tree and alignment programs, run where the data are.

Each alignment is written to a folder of the task's own, the program runs there and its result is read
back; a program that is not installed is an error that names it.
"""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.building import per_alignment
from ..operators.phylo import NODES, frame
from .newick import parse_newick

#: Command of each tree program and the file its tree is in (None: standard output).
TREES = {
    "iqtree": (lambda exe, fasta, o: [exe, "-s", fasta, "-m", o.get("model", "MFP"), "-pre", "out", "-nt", "1", *(["-bb", str(o["bootstrap"])] if o.get("bootstrap") else []), *(["-seed", str(o["seed"])] if o.get("seed") is not None else []), *(["-g", "constraint.nwk"] if o.get("constraint") else [])], "out.treefile"),
    "fasttree": (lambda exe, fasta, o: [exe, *(["-nt"] if o.get("nucleotide", True) else []), fasta], None),
    "raxmlng": (lambda exe, fasta, o: [exe, "--all" if o.get("bootstrap") else "--search", "--msa", fasta, "--model", o.get("model", "GTR+G"), "--prefix", "out", "--threads", "1", "--seed", str(o.get("seed", 1)), *(["--bs-trees", str(o["bootstrap"])] if o.get("bootstrap") else []), *(["--tree-constraint", "constraint.nwk"] if o.get("constraint") else [])], "out.raxml.bestTree"),
    "rapidnj": (lambda exe, fasta, o: [exe, fasta, "-i", "fa", "-a", o.get("model", "kim"), *(["-b", str(o["bootstrap"])] if o.get("bootstrap") else [])], None),
}
NAMES = {"iqtree": ("iqtree2", "iqtree"), "fasttree": ("FastTree", "fasttree"), "raxmlng": ("raxml-ng",), "rapidnj": ("rapidnj",), "mafft": ("mafft",), "muscle": ("muscle",)}


def find(tool: str, path: str | None = None) -> str:
    for name in (path,) if path else NAMES[tool]:
        if exe := shutil.which(name):
            return exe
    raise FileNotFoundError(f"{tool} is not installed; give its path")


def _run(command: list[str], folder: str) -> str:
    done = subprocess.run(command, cwd=folder, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"{command[0]} failed: {done.stderr[-500:]}")
    return done.stdout


def _fasta(folder: str, names: list[str], seqs: list[str]) -> str:
    Path(folder, "in.fasta").write_text("".join(f">{n}\n{s}\n" for n, s in zip(names, seqs)))
    return "in.fasta"


def infer(aln: DataFrame, tool: str = "iqtree", path: str | None = None, **options) -> DataFrame:
    """A node table of the program's tree for each alignment."""
    command, result = TREES[tool]

    def run(aln_id, names, seqs):
        exe = find(tool, path)
        with tempfile.TemporaryDirectory() as folder:
            if options.get("constraint"):
                Path(folder, "constraint.nwk").write_text(options["constraint"])
            said = _run(command(exe, _fasta(folder, names, seqs), options), folder)
            file = "out.raxml.support" if tool == "raxmlng" and options.get("bootstrap") else result
            return frame([(aln_id, parse_newick(said if file is None else Path(folder, file).read_text()))])

    return per_alignment(aln, run, NODES)


def align(records: DataFrame, tool: str = "mafft", path: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """The program's alignment of each set of records."""

    def run(aln_id, names, seqs):
        exe = find(tool, path)
        with tempfile.TemporaryDirectory() as folder:
            fasta = _fasta(folder, names, seqs)
            text = _run([exe, *extra, fasta] if tool == "mafft" else [exe, "-align", fasta, "-output", "out.fasta", *extra], folder)
            text = text if tool == "mafft" else Path(folder, "out.fasta").read_text()
        found = {e.split("\n", 1)[0].split()[0]: e.split("\n", 1)[1].replace("\n", "") for e in text.split(">")[1:]}
        return pd.DataFrame({"aln_id": aln_id, "row_ord": range(len(names)), "name": names, "seq": [found[n] for n in names]})

    return per_alignment(records, run, "aln_id string, row_ord int, name string, seq string")
