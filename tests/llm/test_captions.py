"""Captions, formulas and labels inside an article are text; those of forms are not."""

from tillproof.llm import html_extract as H

PAGE = """<html><body><nav><svg><text>Menu</text></svg></nav><article><h1>Head</h1><p>Mass is <math><mi>E</mi><mo>=</mo>
<mi>m</mi></math> here.</p><figure><img src="a.png"><figcaption>Figure 1: a <b>bridge</b></figcaption></figure>
<p><label>Note</label> on <object data="x"><param name="a">a chart</object>, <svg viewBox="0 0 1 1"><path d="M0"/><text>axis</text></svg> end</p>
<form><label>Mail</label><figcaption>none</figcaption></form></article><footer><math>x</math></footer></body></html>"""


def test_captions_and_formulas_stay():
    assert H.Page(PAGE).text(None) == "Head\nMass is E= m here.\nFigure 1: a bridge\nNote on a chart, axis end"
