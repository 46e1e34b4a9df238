"""Knowledge-graph evidence queries."""

from __future__ import annotations

from vernissage.functions import fixed
from vernissage.operators import audit, knowledge
from vernissage.plans import views
from vernissage.plans.registry import query
from vernissage.plans.views import with_views

_HITS = ", ".join(
    "max(cast(" + " or ".join(f"contains(lower(trim(label)), '{f}')" for f in fragments) + f" as int)) as {c}"
    for c, fragments in fixed.MATERIAL_FRAGMENTS.items()
)
ITEMS = f"select item, {_HITS} from bindings group by item"
RULE = """
case when watercolor = 1 then 7 when acrylic_mat = 1 then 0 when tempera_mat = 1 or gold = 1 then 6
  when print_mat = 1 then 5
  when oil = 1 or oil_canvas = 1 or oil_panel = 1 or oil_wood = 1 then
    case when canvas_support = 1 then 2 when panel_support = 1 then 3 when wood_support = 1 then 4
      when oil_canvas = 1 then 2 when oil_panel = 1 then 3 when oil_wood = 1 then 4 else 2 end
  when ink_mat = 1 then 1 else -1 end"""
FLAGS = ", ".join(f"coalesce({c}, 0) as wd_{c}" for c in fixed.MATERIAL_FLAGS)
EVIDENCE = f"select a.id, {RULE} as wd_pred, {FLAGS} from artworks a left join ({ITEMS}) i on i.item = a.wikidataid"
ACCURACY = (
    "select count(*) filter (where wd_pred <> -1 and wd_pred = y)::double / nullif(count(*) filter (where wd_pred <> -1), 0) "
    "as rule_accuracy, count(*) filter (where wd_pred <> -1) as n_covered, count(*) as n_rows "
    f"from captions c join ({EVIDENCE}) e using (id) where split = 'train'"
)


def facts(spark, sf):
    return knowledge.evidence(views.artworks(spark, sf), views.bindings(spark, sf), unique=True)


@query("material_flags", with_views(EVIDENCE, "artworks", "bindings"))
def material_flags(spark, sf):
    return facts(spark, sf)


@query(
    "material_categories",
    with_views(ITEMS, "bindings"),
)
def material_categories(spark, sf):
    return knowledge.item_categories(views.bindings(spark, sf))


@query("material_rule_class", with_views(f"select id, wd_pred from ({EVIDENCE})", "artworks", "bindings"))
def material_rule_class(spark, sf):
    return facts(spark, sf).select("id", "wd_pred")


@query("rule_accuracy", with_views(ACCURACY, "captions", "bindings"))
def rule_accuracy(spark, sf):
    return knowledge.rule_accuracy(views.train_rows(spark, sf), facts(spark, sf))


@query(
    "rule_accuracy_disagree",
    with_views(ACCURACY + " and cap_y is distinct from y", "captions", "bindings"),
)
def rule_accuracy_disagree(spark, sf):
    rows = audit.with_weak_label(views.train_rows(spark, sf))
    return knowledge.rule_accuracy(rows.filter("not (cap_y <=> y)"), facts(spark, sf))
