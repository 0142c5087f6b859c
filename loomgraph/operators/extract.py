"""Definitions, imports, calls, throws and usages from source lines, by one table of patterns for each language.

Everything is a Column expression over exploded lines; scopes come from an interval join by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAME = r"([A-Za-z_$][\w$]*)"
#: language -> (pattern with the name as its first group, label)
DEFINITIONS: dict[str, list[tuple[str, str]]] = {
    "python": [(rf"^(?:async\s+)?def\s+{NAME}", "Function"), (rf"^\s+(?:async\s+)?def\s+{NAME}", "Method"), (rf"^\s*class\s+{NAME}", "Class"), (rf"^{NAME}\s*(?::[^=]+)?=(?!=)", "Variable")],
    "javascript": [(rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+{NAME}", "Function"), (rf"^\s*(?:export\s+)?(?:const|let|var)\s+{NAME}\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>", "Function"), (rf"^\s*(?:export\s+)?(?:default\s+)?class\s+{NAME}", "Class"), (rf"^(?:export\s+)?(?:const|let|var)\s+{NAME}", "Variable")],
    "go": [(rf"^func\s+{NAME}", "Function"), (rf"^func\s+\([^)]*\)\s*{NAME}", "Method"), (rf"^type\s+{NAME}\s+struct", "Class"), (rf"^type\s+{NAME}\s+interface", "Interface")],
    "rust": [(rf"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+{NAME}", "Function"), (rf"^\s+(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+{NAME}", "Method"), (rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union|type)\s+{NAME}", "Class"), (rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{NAME}", "Interface"), (rf"^\s+(?:pub\s+)?{NAME}\s*:\s*[A-Z&\[]", "Field")],
    "zig": [(rf"^\s*(?:pub\s+)?(?:export\s+)?(?:inline\s+)?fn\s+{NAME}", "Function"), (rf"^\s*(?:pub\s+)?const\s+{NAME}\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)", "Struct"), (rf"^\s*(?:pub\s+)?(?:const|var)\s+{NAME}", "Constant"), (r"^\s*test\s+\"([^\"]+)\"", "Test")],
    "java": [(rf"^\s*(?:(?:public|private|protected|abstract|final|static|sealed)\s+)*(?:class|enum|record)\s+{NAME}", "Class"), (rf"^\s*(?:(?:public|private|protected|abstract)\s+)*@?interface\s+{NAME}", "Interface"), (rf"^\s+(?:(?:public|private|protected|static|final|synchronized|abstract)\s+)+[\w<>\[\],.? ]*?{NAME}\s*\([^;]*$", "Method")],
    "csharp": [(rf"^\s*(?:(?:public|private|protected|internal|abstract|sealed|static|partial)\s+)*(?:class|struct|record|enum)\s+{NAME}", "Class"), (rf"^\s*(?:(?:public|internal)\s+)*interface\s+{NAME}", "Interface"), (rf"^\s+(?:(?:public|private|protected|internal|static|virtual|override|async)\s+)+[\w<>\[\],.? ]*?{NAME}\s*\([^;]*$", "Method")],
    "powershell": [(r"^\s*(?i:function)\s+([\w-]+)", "Function"), (rf"^\s*(?i:class)\s+{NAME}", "Class")],
    "gdscript": [(rf"^(?:static\s+)?func\s+{NAME}", "Function"), (rf"^\s+(?:static\s+)?func\s+{NAME}", "Method"), (rf"^(?:class|class_name)\s+{NAME}", "Class")],
    "yaml": [(r"^\s*(?:-\s+)?([\w./-]+)\s*:(?:\s|$)", "Variable")],
    "toml": [(r"^\s*\[+([\w.\"-]+)\]+", "Class"), (r"^\s*([\w.-]+)\s*=", "Variable")],
}
DEFINITIONS["typescript"] = DEFINITIONS["tsx"] = [*DEFINITIONS["javascript"], (rf"^\s*(?:export\s+)?(?:abstract\s+class|enum|interface|type|namespace)\s+{NAME}", "Interface")]
IMPORTS: dict[str, str] = {
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "javascript": r"""(?:\bfrom\s+|\brequire\(\s*|^\s*import\s+)["']([^"']+)["']()""",
    "go": r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"()\s*$""",
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)()\s*;",
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)()",
    "zig": r"""@import\("([^"]+)"\)()""",
    "csharp": r"^\s*using\s+([\w.]+)()\s*;",
}
IMPORTS["typescript"] = IMPORTS["tsx"] = IMPORTS["javascript"]
NOT_CALLS = "if for while switch return await else catch true false new this class interface const let var fn pub impl struct enum trait async use from as in is def function func elif with and or not".split()
STRINGS = r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'"""


#: What can hold more than a line, by kind of language; then what else must be passed over whole.
BLOCKS = {
    ("javascript", "typescript", "tsx", "go", "java", "csharp", "rust"): (r"/\*[\s\S]*?(?:\*/|\z)|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`", r"//[^\n]*+", r"/\*|`"),
    ("python",): (r"\"\"\"[\s\S]*?(?:\"\"\"|\z)|'''[\s\S]*?(?:'''|\z)", r"#[^\n]*+", r"\"\"\"|'''"),
}
WHOLE = r""""[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"""


def masked(content: Column, language: Column) -> Column:
    """The text with block comments, and strings over several lines, blanked out but for their line ends, so
    that lines keep their numbers. Such marks inside ordinary strings and line comments begin nothing."""
    out = content
    for languages, (block, comment, marks) in BLOCKS.items():
        pieces = F.regexp_extract_all(content, F.lit(f"{block}|{comment}|{WHOLE}|[^\"'/`#]++|[\\s\\S]"), F.lit(0))
        blank = lambda p: F.when(p.rlike(f"^(?:{marks})") & (p.contains("\n") | p.startswith("/*")), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)  # noqa: B023, E731
        out = F.when(language.isin(*languages) & content.rlike(marks), F.array_join(F.transform(pieces, blank), "")).otherwise(out)
    return out


def source_lines(files: DataFrame) -> DataFrame:
    """file_path, language, line and code of files with content, without what lies in blocks over lines."""
    code = masked(F.col("content"), F.col("language"))
    return files.select("file_path", "language", F.posexplode(F.split(code, "\r?\n", -1)).alias("_i", "code")).select("file_path", "language", (F.col("_i") + 1).alias("line"), "code")


def definitions(lines: DataFrame) -> DataFrame:
    """file_path, language, line, name and label: the first pattern of a line's language that matches."""
    found = F.lit(None).cast("struct<name:string,label:string>")
    for language, table in DEFINITIONS.items():
        for pattern, label in reversed(table):
            name = F.regexp_extract("code", pattern, 1)
            found = F.when((F.col("language") == language) & (name != ""), F.struct(name.alias("name"), F.lit(label).alias("label"))).otherwise(found)
    return lines.withColumn("_d", found).where("_d is not null").select("file_path", "language", "line", "_d.name", "_d.label")


def spans(defined: DataFrame, lines: DataFrame) -> DataFrame:
    """Definitions with start and end: up to the next one of the file, or the file's end."""
    ahead = Window.partitionBy("file_path").orderBy("line").rangeBetween(1, Window.unboundedFollowing)
    sizes = lines.groupBy("file_path").agg(F.max("line").alias("_n"))
    return defined.join(sizes, "file_path").withColumn("start_line", F.col("line")).withColumn("end_line", F.coalesce(F.min("line").over(ahead) - 1, F.col("_n"))).drop("line", "_n")


#: language -> patterns whose first group is the name that a whole module gets in the file
MODULE_NAMES: dict[str, list[str]] = {
    "javascript": [r"^\s*import\s+(?:type\s+)?([A-Za-z_$][\w$]*)\s*(?:,|\bfrom\b)", r"\*\s+as\s+([A-Za-z_$][\w$]*)", r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*require\("],
    "go": [r"^\s*(?:import\s+)?(?!import\b)([A-Za-z_]\w*)\s+\""],
    "zig": [r"(?:const|var)\s+([A-Za-z_]\w*)\s*=\s*@import"],
    "rust": [r"\bas\s+([A-Za-z_]\w*)\s*;"],
}
MODULE_NAMES["typescript"] = MODULE_NAMES["tsx"] = MODULE_NAMES["javascript"]
#: language -> (pattern whose first group lists what is taken out of a module, what stands between the two)
PARTS_OF: dict[str, tuple[str, str]] = {
    "python": (r"^\s*from\s+[\w.]+\s+import\s+\(?([^#);]*)", "."),
    "javascript": (r"^[^{]*\{([^}]*)\}\s*(?:from\b|=\s*require\()", "."),
    "rust": (r"::\{([^}]*)\}", "::"),
}
PARTS_OF["typescript"] = PARTS_OF["tsx"] = PARTS_OF["javascript"]


def imports(lines: DataFrame) -> DataFrame:
    """file_path, line, target, alias and linked: each module that a line imports (linked, with the name that
    the file knows it by, if any), and each name that it takes out of a module (target `module.name`)."""
    target, parts, between, known = F.lit(""), F.lit(""), F.lit("."), F.lit("")
    for language, pattern in IMPORTS.items():
        both = F.concat(F.regexp_extract("code", pattern, 1), F.regexp_extract("code", pattern, 2))
        target = F.when(F.col("language") == language, both).otherwise(target)
    for language, (pattern, sign) in PARTS_OF.items():
        own = F.col("language") == language
        parts, between = F.when(own, F.regexp_extract("code", pattern, 1)).otherwise(parts), F.when(own, F.lit(sign)).otherwise(between)
    for language, patterns in MODULE_NAMES.items():
        known = F.when(F.col("language") == language, F.concat(*(F.regexp_extract("code", x, 1) for x in patterns))).otherwise(known)
    rows = lines.select("file_path", "line", "language", "code", F.regexp_replace(target, "::$", "").alias("_module"), parts.alias("_parts"), between.alias("_between"), known.alias("_known")).where("_module != ''")
    last = lambda x: F.coalesce(F.element_at(F.filter(F.split(x, r"[/.:]+"), lambda y: y != ""), -1), F.lit(""))

    def listed(names: Column, prefix: Column, linked: bool) -> Column:
        """Entries such as `a, b as c, d: e`."""
        each = F.filter(F.transform(F.split(names, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Za-z_$]"))

        def entry(x: Column) -> Column:
            sides = F.split(x, r"\s+as\s+|\s*:(?!:)\s*")
            path = F.concat(prefix, sides[0])
            return F.struct(path.alias("target"), F.when(F.size(sides) > 1, sides[1]).otherwise(last(sides[0])).alias("alias"), F.lit(linked).alias("linked"))

        return F.transform(each, entry)

    plain = (F.col("language") == "python") & F.col("code").rlike(r"^\s*import\s")
    modules = F.regexp_extract("code", r"^\s*import\s+([^#;]*)", 1)
    taken = F.col("_parts") != ""
    name = F.when(F.col("_known") != "", F.col("_known")).when(taken, F.lit("")).otherwise(last(F.col("_module")))
    whole = F.array(F.struct(F.col("_module").alias("target"), name.alias("alias"), F.lit(True).alias("linked")))
    found = F.when(plain, listed(modules, F.lit(""), True)).otherwise(F.concat(whole, listed(F.col("_parts"), F.concat("_module", "_between"), False)))
    return rows.select("file_path", "line", F.explode(found).alias("_b")).select("file_path", "line", "_b.*")


def calls(lines: DataFrame) -> DataFrame:
    """file_path, line, callee and its first string: names before an opening parenthesis, outside strings and
    comments, other than keywords and what follows `new`. The string is the call's first argument, or the
    line's first string where the line has no other call."""
    bare = F.regexp_replace(F.regexp_replace(F.col("code"), STRINGS, '""'), r"(#|//).*$", "")
    bare = F.regexp_replace(bare, r"\bnew\s+[\w.]+\s*\(", "(")
    bare = F.regexp_replace(bare, r"^\s*(?:export\s+|pub\s+|async\s+|static\s+)*(?:def|function|func|fn)\s+(?:\([^)]*\)\s*)?[\w$]+\s*\(", "(")
    names = F.regexp_extract_all(bare, F.lit(r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\("), F.lit(1))
    first = F.regexp_extract("code", r"""["']([^"']*)["']""", 1)
    made = lines.select("file_path", "line", "code", F.explode(names).alias("callee"), F.when(F.size(names) == 1, first).alias("_first"))
    own = F.expr(r"""regexp_extract(code, concat('(?<![\\w$.])\\Q', callee, '\\E\\s*\\(\\s*["\']([^"\']*)["\']'), 1)""")
    made = made.select("file_path", "line", "callee", F.coalesce(F.nullif(own, F.lit("")), F.nullif("_first", F.lit(""))).alias("first_string"))
    return made.where(~F.substring_index("callee", ".", -1).isin(NOT_CALLS))


def throws(lines: DataFrame) -> DataFrame:
    """file_path, line and exception of throw statements."""
    name = F.regexp_extract("code", r"\bthrow\s+(?:new\s+)?([A-Za-z_$][\w$.]*)", 1)
    return lines.where(F.col("language").isin("javascript", "typescript", "tsx")).withColumn("exception", name).where("exception != ''").select("file_path", "line", "exception")


def usages(lines: DataFrame) -> DataFrame:
    """file_path, line and name of types after a colon or arrow, class bases and decorators."""
    found = F.flatten(F.array(F.regexp_extract_all("code", F.lit(r"(?::|->)\s*&?([A-Z]\w*)"), F.lit(1)), F.regexp_extract_all("code", F.lit(r"\b(?:extends|implements)\s+([A-Z]\w*)"), F.lit(1)), F.regexp_extract_all("code", F.lit(r"^\s*class\s+\w+\(([A-Z]\w*)"), F.lit(1)), F.regexp_extract_all("code", F.lit(r"^\s*@([A-Za-z_][\w.]*)"), F.lit(1))))
    return lines.select("file_path", "line", F.explode(F.array_distinct(found)).alias("name"))


def routes(lines: DataFrame) -> DataFrame:
    """file_path, line, method and path of route registrations and decorators."""
    pattern = r"""(?:@|\b)[\w.]+\.(get|post|put|delete|patch|head|options|route)\(\s*["'](/[^"']*)["']"""
    method = F.regexp_extract("code", pattern, 1)
    return lines.withColumn("path", F.regexp_extract("code", pattern, 2)).where("path != ''").select("file_path", "line", F.when(method == "route", "ANY").otherwise(F.upper(method)).alias("method"), "path")

