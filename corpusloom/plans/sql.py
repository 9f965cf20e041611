"""SQL fragments shared by the DuckDB twins of the registered queries.

Each fragment is a common table expression; ``with_ctes`` puts the needed ones in front
of a query.
"""

from __future__ import annotations


def text(value: str) -> str:
    """A string literal."""
    body = value.replace("'", "''")
    if "\n" not in body:
        return f"'{body}'"
    return "concat(" + ", chr(10), ".join(f"'{part}'" for part in body.split("\n")) + ")"


def u100(salt: str, col: str) -> str:
    return f"(cast(concat('0x', substr(md5(concat('{salt}:', cast({col} as varchar))), 1, 8)) as bigint) % 100)"


def key(salt: str, *cols: str) -> str:
    parts = ", ".join(f"':', cast({c} as varchar)" for c in cols)
    return f"md5(concat('{salt}', {parts}))"


def big(hex_key: str, digits: int = 15) -> str:
    return f"cast(concat('0x', substr({hex_key}, 1, {digits})) as bigint)"


def unit(hex_key: str) -> str:
    return f"(cast({big(hex_key, 13)} as double) / {float(16**13):.1f})"


def words(col: str) -> str:
    return f"list_filter(string_split_regex({col}, '[ \\t\\n\\r\\f]+'), lambda t: t <> '')"


_INV, _ERR = u100("inv", "doc_id"), u100("err", "doc_id")

CTES: dict[str, str] = {}

CTES["corpus"] = """
select d.doc_id, d.text,
  case when l.quality = 1 and l.toxic = 1 then 'good_toxic' when l.quality = 1 then 'good'
       when l.toxic = 1 then 'bad_toxic' else 'bad' end as label
from documents d join labels l on d.doc_id = l.doc_id"""

CTES["raw_corpus"] = f"""
select doc_id,
  case when {u100('hole', 'doc_id')} < 3 then 'NA' when {u100('hole', 'doc_id')} < 5 then ''
       when {u100('hole', 'doc_id')} < 7 then 'NaN' else text end as text,
  case when {u100('nolabel', 'doc_id')} < 4 then 'null' else label end as label
from corpus"""

CTES["classes"] = """
select label as label_text, count(*) as n,
  cast(row_number() over (order by min(doc_id), label) - 1 as bigint) as label_code
from corpus group by label"""

CTES["coded"] = """
select c.doc_id, c.text, c.label, k.label_code, k.label_text
from corpus c join classes k on c.label = k.label_text"""

CTES["split1"] = f"""
select *, row_number() over (order by {key('split42', 'doc_id')}, doc_id)
  <= ceil(cast(0.2 as double) * count(*) over ()) as held_out from coded"""

CTES["split2"] = f"""
select doc_id, row_number() over (order by {key('val42', 'doc_id')}, doc_id)
  <= ceil(cast(0.2 as double) * count(*) over ()) as inner_out from split1 where not held_out"""

CTES["splits"] = """
select s.doc_id, s.text, s.label, s.label_code, s.label_text,
  case when s.held_out then 'eval' when v.inner_out then 'val' else 'train' end as split
from split1 s left join split2 v on s.doc_id = v.doc_id"""

CTES["train"] = "select * from splits where split = 'train'"

CTES["train_classes"] = """
select label_code, label_text, count(*) as n from train group by label_code, label_text"""

CTES["predictions"] = f"""
select doc_id, label as label_true,
  case when {_INV} < 6 then concat('INVALID LABEL: ', label) when {_ERR} < 25 then 'good' else label end as label_pred,
  {_INV} >= 6 as status
from corpus"""

_RUN = "concat(doc_id, ':', n_samples)"
CTES["run_predictions"] = f"""
select doc_id, n_samples, label as label_true,
  case when {u100('inv', _RUN)} < 6 then concat('INVALID LABEL: ', label)
       when {u100('err', _RUN)} < 25 then 'good' else label end as label_pred,
  {u100('inv', _RUN)} >= 6 as status
from corpus, (select unnest(range(1, 8)) as n_samples)"""

CTES["marks"] = f"""
select doc_id, 'A' as project, label from corpus where {u100('missA', 'doc_id')} >= 3
union all select doc_id, 'A', 'other' from corpus
  where {u100('multiA', 'doc_id')} < 5 and {u100('missA', 'doc_id')} >= 3
union all select doc_id, 'B', case when {u100('dis', 'doc_id')} < 20 then 'good'
  when {u100('dis', 'doc_id')} < 25 then 'other' else label end
from corpus where {u100('missB', 'doc_id')} >= 3"""

CTES["label_sets"] = """
select project, concat('doc_', doc_id, '.pdf') as pdf_file, string_agg(label, ',' order by k) as labels
from (select distinct doc_id, project, label,
        list_position(['good', 'bad', 'good_toxic', 'bad_toxic', 'other'], label) as k from marks)
group by project, doc_id"""

CTES["pairs"] = """
select a.pdf_file, a.labels as labels_a, b.labels as labels_b
from label_sets a join label_sets b on a.pdf_file = b.pdf_file
where a.project = 'A' and b.project = 'B'"""

_FOUR = "('good', 'bad', 'good_toxic', 'bad_toxic')"
CTES["filtered"] = f"""
select pdf_file,
  case when labels_a in {_FOUR} then labels_a else 'Not relevant' end as labels_a,
  case when labels_b in {_FOUR} then labels_b else 'Not relevant' end as labels_b
from pairs"""

CTES["generations"] = f"""
select doc_id, label, prompt, concat(prompt,
  case when {u100('nomark', 'doc_id')} < 8 then 'x' else concat(chr(10), 'Category: ') end,
  case when {u100('bad', 'doc_id')} < 10 then 'maybe' when {u100('bad', 'doc_id')} < 13 then '' else label end,
  case when {u100('nonl', 'doc_id')} < 6 then '' else concat(chr(10), '###') end) as generated_text
from (select doc_id, label, concat('<<<', chr(10), 'Inquiry: ', text, chr(10), '>>>') as prompt from corpus)"""

CTES["trial_log"] = f"""
select trial, step, value, case when u < 10 then 'RUNNING' when u < 30 then 'PRUNED'
  when u < 45 then 'FAIL' else 'COMPLETE' end as state
from (select *, {u100('state', 'trial')} as u from (
  select user_id as trial, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as step,
    max(value) as value from events group by all))"""

CTES["results"] = """
select trial, max_by(state, step) as state, max_by(value, step) as value from trial_log group by trial"""

CTES["tokens"] = f"select doc_id, {words('text')}[1:512] as tokens from documents"

NEEDS: dict[str, tuple[str, ...]] = {
    "raw_corpus": ("corpus",),
    "classes": ("corpus",),
    "coded": ("corpus", "classes"),
    "split1": ("coded",),
    "split2": ("split1",),
    "splits": ("split1", "split2"),
    "train": ("splits",),
    "train_classes": ("train",),
    "predictions": ("corpus",),
    "run_predictions": ("corpus",),
    "marks": ("corpus",),
    "label_sets": ("marks",),
    "pairs": ("label_sets",),
    "filtered": ("pairs",),
    "generations": ("corpus",),
    "results": ("trial_log",),
}


def with_ctes(names: str, body: str, **extra: str) -> str:
    """``body`` behind the named fragments, what they need, and ``extra`` ones in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} as ({CTES[n]})" for n in ordered] + [f"{n} as ({s})" for n, s in extra.items()]
    return f"with {', '.join(parts)} {body}" if parts else body
