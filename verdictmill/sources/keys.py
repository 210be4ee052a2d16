"""Answer keys and templates kept as YAML. Files of this kind are small and hand-written; they are parsed on the
driver, and what is wrong in them becomes rows of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CASES = "set_version int, id string, turn string, should_fire boolean, why string, routes array<string>, band string, triple string, domain string, stakes string, ask string, kind string"
ISSUES = "key string, message string"
_STRATA = ("band", "triple", "domain", "stakes", "ask", "kind")


def parse_key(doc: dict, sections: tuple[tuple[str, bool], ...] = (("should_fire", True), ("should_not_fire", False))) -> tuple[list[tuple], list[tuple[str, str]]]:
    """Rows and issues of one key: the section tells the label, and what contradicts it is an issue."""
    rows, issues, seen = [], [], set()
    version = doc.get("version", 1)
    for section, label in sections:
        for case in doc.get(section) or []:
            name = str(case.get("id"))
            routes = case.get("routes") or ([case["route"]] if case.get("route") else [])
            problems = [
                (name in seen, "duplicate id"),
                (not label and bool(routes), "a negative has a route"),
                (label and bool(case.get("kind")), "a positive has a kind"),
                (len(set(routes)) < len(routes), "duplicate route"),
                (not str(case.get("turn") or "").strip(), "no turn"),
            ]
            issues += [(name, message) for wrong, message in problems if wrong]
            seen.add(name)
            rows.append((version, name, case.get("turn"), label, case.get("why"), routes, *(case.get(s) for s in _STRATA)))
    if not rows:
        issues.append(("", "empty key"))
    return rows, issues


def load_key(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(cases, issues) of a key's YAML text."""
    import yaml

    rows, issues = parse_key(yaml.safe_load(text) or {})
    return spark.createDataFrame(rows, CASES), spark.createDataFrame(issues, ISSUES)


def parse_only(text: str, spark: SparkSession | None = None) -> tuple[str, ...]:
    """A selection: a comma list, or ``@path`` of a file with one id on a line; there, blank lines and lines that begin with ``#`` count for nothing."""
    if text.startswith("@"):
        lines = (spark or SparkSession.getActiveSession()).read.text(text[1:], wholetext=True).first().value.splitlines()
        return tuple(x.strip() for x in lines if x.strip() and not x.strip().startswith("#"))
    return tuple(x.strip() for x in text.split(",") if x.strip())


def select_cases(cases: DataFrame, only: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Cases named by ``only`` (id; an unknown one is refused) without those of ``exclude`` (id)."""
    from pyspark.sql import functions as F

    from ..operators.guards import require

    if only is not None:
        require(only.join(cases, "id", "left_anti"), unknown_id=F.lit(True))
        cases = cases.join(only, "id", "left_semi")
    return cases.join(exclude, "id", "left_anti") if exclude is not None else cases


def load_keys(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases with their ``key``, issues with their ``key``, rejects) of all keys below a folder: ``*.yaml``, and ``*/index.yaml`` with the files it includes.

    A file that is no key becomes a row of rejects (key, message), not silence.
    """
    files = _texts(spark, root)
    rows, issues, rejects = [], [], []
    for path in sorted(p for p in files if p.count("/") == 0 or p.count("/") == 1 and p.endswith("/index.yaml")):
        try:
            doc = _document(files, path)
            own, found = parse_key(doc)
        except (ValueError, TypeError, AttributeError) as e:
            rejects.append((path, str(e).split("\n")[0]))
            continue
        rows += [(path, *r) for r in own]
        issues += [(path, k, m) for k, m in found]
    return spark.createDataFrame(rows, f"key string, {CASES}"), spark.createDataFrame(issues, "key string, id string, message string"), spark.createDataFrame(rejects, ISSUES)


def _texts(spark: SparkSession, root: str, suffix: str = ".yaml") -> dict[str, str]:
    """Small files below a folder by their path in it."""
    base = root.rstrip("/") + "/"
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(root, wholetext=True).selectExpr("input_file_name() as path", "value").collect()
    return {r.path.split(base, 1)[-1]: r.value for r in read}


def _document(files: dict[str, str], path: str) -> dict:
    """A key with the sections of the files that it includes (by path beside it) appended."""
    import yaml

    try:
        doc = yaml.safe_load(files[path])
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e
    if not isinstance(doc, dict):
        raise ValueError("no mapping")
    folder = path.rpartition("/")[0]
    for name in doc.get("include") or []:
        part = f"{folder}/{name}".lstrip("/")
        if part not in files:
            raise ValueError(f"includes {name}, which is not there")
        more = yaml.safe_load(files[part]) or {}
        for section in ("should_fire", "should_not_fire"):
            doc[section] = [*(doc.get(section) or []), *(more.get(section) or [])]
    return doc


def load_declared_versions(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(file, version) of a table of a TOML file, by its dotted name; empty where it is absent."""
    import tomllib

    node: object = tomllib.loads(spark.read.text(path, wholetext=True).first().value)
    for part in table.split("."):
        node = node.get(part, {}) if isinstance(node, dict) else {}
    rows = [(str(k), int(v)) for k, v in node.items()] if isinstance(node, dict) else []
    return spark.createDataFrame(rows, "file string, version int")


TEMPLATES = "template_id string, question string, options array<string>, solution string, variables map<string,string>, facts array<struct<id: string, text: string>>, distractors array<struct<id: string, text: string>>"


def load_templates(spark: SparkSession, root: str) -> DataFrame:
    """Templates of a folder of YAML files, in the order of their ids. A file that is none, or whose id is not its name, is refused, and so is a folder without any."""
    import yaml

    rows = []
    for path, text in sorted(_texts(spark, root).items()):
        doc = yaml.safe_load(text)
        missing = [k for k in ("template_id", "question", "options", "solution") if not isinstance(doc, dict) or not doc.get(k)]
        if missing:
            raise ValueError(f"{path}: no {', '.join(missing)}")
        if doc["template_id"] != path.rpartition("/")[2].removesuffix(".yaml"):
            raise ValueError(f"{path}: template_id {doc['template_id']!r} is not the file's name")
        told = lambda name: [(str(x["id"]), str(x["text"])) for x in doc.get(name) or []]
        rows.append((doc["template_id"], doc["question"], [str(o) for o in doc["options"]], doc["solution"], {str(k): str(v) for k, v in (doc.get("variables") or {}).items()}, told("relevant_facts"), told("distractors")))
    if not rows:
        raise ValueError(f"no templates in {root}")
    return spark.createDataFrame(rows, TEMPLATES).orderBy("template_id")


CASEFILES = (
    "case_id string, trap_order string, documents array<string>, conditions array<struct<id: string, source: string, governs: boolean>>, actions array<struct<id: string, status: string, failure_kind: string, licensed_by: array<string>>>, "
    "exposure_band string, first_order_band string, pivot_present boolean, pivot_accepts array<string>"
)


def load_casefiles(spark: SparkSession, root: str) -> DataFrame:
    """Casefiles of a folder of YAML files, in the order of their names; an empty folder is refused."""
    import yaml

    rows = []
    for _, text in sorted(_texts(spark, root).items()):
        raw = yaml.safe_load(text)
        exposure, pivot = raw.get("exposure") or {}, raw.get("pivot") or {}
        conditions = [(str(c["id"]), str(c.get("source")), bool(c.get("governs"))) for c in raw.get("conditions") or []]
        actions = [(str(a["id"]), a.get("status"), a.get("failure_kind"), [str(x) for x in a.get("licensed_by") or []]) for a in raw.get("actions") or []]
        rows.append((str(raw["case_id"]), str(raw.get("trap_order")), [str(d["id"]) for d in raw.get("documents") or []], conditions, actions, exposure.get("band"), exposure.get("first_order_wrong_answer"), pivot.get("present"), pivot.get("accepts")))
    if not rows:
        raise ValueError(f"no casefiles in {root}")
    return spark.createDataFrame(rows, CASEFILES)


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(id, body): each Markdown file below a folder, and each document of its YAML casefiles (``file:id``)."""
    import yaml
    from pyspark.sql import functions as F

    notes = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    notes = notes.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("id"), F.col("value").alias("body"))
    own = [(f"{p.rpartition('/')[2].removesuffix('.yaml')}:{d['id']}", d["body"]) for p, text in sorted(_texts(spark, root).items()) for d in (yaml.safe_load(text) or {}).get("documents") or []]
    return notes.unionByName(spark.createDataFrame(own, "id string, body string"))


def load_lock(spark: SparkSession, path: str) -> DataFrame:
    """The row of a JSON lock of a vendored file; a field that is missing is refused."""
    from pyspark.sql import functions as F

    from ..operators.guards import require

    names = ("repo", "commit", "member", "size_bytes", "sha256", "code_license", "data_license", "retrieved")
    row = spark.read.schema(", ".join(f"{n} {'long' if n == 'size_bytes' else 'string'}" for n in names)).option("multiLine", True).json(path)
    return require(row, **{f"no_{n}": F.col(n).isNull() for n in names})


def positives(cases: DataFrame) -> DataFrame:
    return cases.filter("should_fire")


def negatives(cases: DataFrame) -> DataFrame:
    return cases.filter("not should_fire")
