"""No rule's match is hidden by the gate or by the rule's keyword."""

import itertools
import re._constants as c
import re._parser as parser

from chronoweave.llm import licences


def examples(parsed):
    """The shortest texts of each alternative of a pattern, with line breaks as white space."""
    parts = []
    for op, arg in parsed:
        if op is c.LITERAL:
            parts.append([chr(arg)])
        elif op is c.IN:
            parts.append(["\n" if arg[0][0] is c.CATEGORY else chr(arg[0][1])] if arg[0][0] is not c.IN else [""])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            parts.append(examples(arg[2]) if arg[0] else [""])
        elif op is c.SUBPATTERN:
            parts.append(examples(arg[-1]))
        elif op is c.BRANCH:
            parts.append([e for branch in arg[1] for e in examples(branch)])
        elif op is c.ANY:
            parts.append(["x"])
        else:
            assert op in (c.AT, c.ASSERT, c.ASSERT_NOT), op
    return ["".join(p) for p in itertools.product(*parts)]


def test_every_rule_passes_gate_and_keyword():
    gate = licences.gate()
    for label, keyword, _, pattern in licences.rules():
        for e in examples(parser.parse(pattern)):
            assert any(g in e for g in gate), (label, e)
            assert any(k in e for k in keyword.split("|")), (label, keyword, e)


def test_mentions_without_the_word_licence(spark):
    cases = {"released under Apache 2.0": "apache-2.0", "BSD 3-Clause": "bsd-3-clause", "2-clause BSD": "bsd-2-clause", "MPL 2.0": "mpl-2.0", "EPL 2.0": "epl-2.0", "CDDL 1.0": "cddl-1.0", "EUPL 1.2": "eupl-1.2", "MIT-0": "mit-0", "0BSD": "0bsd", "historical permission\nnotice and disclaimer": "hpnd", "see eclipse.org/legal/epl-2.0": "epl-2.0", "scripts.sil.org/ofl": "ofl-1.1", "mariadb.com/bsl11": "busl-1.1", "All rights\nreserved": "proprietary", "released to the public\tdomain": "public-domain", "GNU Free\nDocumentation License": "gfdl", "CC\nBY 4.0": "cc-by-4.0"}
    got = {r.text: {m.label for m in r.matches} for r in licences.scan(spark.createDataFrame([(t,) for t in cases], "text string")).collect()}
    assert {t: label for t, label in cases.items() if label not in got[t]} == {}
