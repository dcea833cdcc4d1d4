from chronofold.llm.licenses import TEMPLATES, scan

TEXT = {}
for name, text in TEMPLATES:
    TEXT[name] = max(TEXT.get(name, ""), text, key=len)
FILL = " and then some other prose about rivers and mountains " * 6


def stated(spark, texts):
    rows = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    out = {i: set() for i in range(len(texts))}
    for r in rows:
        if r.license:
            out[r.doc_id].add(r.license)
    return [out[i] for i in range(len(texts))]


def test_notice_that_begins_like_another(spark):
    two, three = TEXT["BSD-2-Clause"], TEXT["BSD-3-Clause"]
    assert stated(spark, [three + FILL + two, two + FILL + three, three + " " + two, two + FILL + two, three]) == [
        {"BSD-2-Clause", "BSD-3-Clause"}] * 3 + [{"BSD-2-Clause"}, {"BSD-3-Clause"}]


def test_short_notices_are_told_apart(spark):
    assert stated(spark, [
        "Licensed under the BSD License.", "This work is licensed under the GNU Affero General Public License, version 3.",
        "This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under the Foo License.", "Licensed under the MIT License.",
        "All rights were never reserved by anyone", "All rights reserved."]) == [
        {"BSD"}, {"AGPL-3.0"}, {"LGPL-3.0"}, {"CC-BY-SA-4.0"}, {"GPL-2.0"}, set(), {"MIT"}, set(), {"All-Rights-Reserved"}]


def test_every_template_states_its_license(spark):
    assert stated(spark, [FILL + t + FILL for _, t in TEMPLATES]) == [{n} for n, _ in TEMPLATES]
