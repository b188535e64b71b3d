"""The URL vocabulary, measured on labelled urls."""

import pytest

from promptlake.llm import url_filter
from promptlake.llm.queries import RULES

# Written by hand: pages that a reader would keep, and pages that a filter is for.
GOOD = """
en.wikipedia.org/wiki/Adult_education example.org/adult-literacy library.org/young-adult/novels school.edu/sex-education/lesson bio.edu/genetics/sex-ratio film.org/casino_royale_(film) film.org/reviews/casino-royale-1967
fsf.org/download/free-software farm.org/farm/track/12 city.org/paris/free-walking-tour city.org/paris/promotion radio.org/free-press/free-speech river.net/torrent-river mail.org/help/spam-filter mail.org/help/spam-folder/report
bank.org/student-loans/apply bank.org/home-loan/rates museum.org/nude-painting/venus art.org/modigliani/nude-art geo.edu/carbon-dating/methods lab.edu/radiometric-dating health.org/gambling-addiction/help gov.uk/gambling-act-2005
police.uk/phishing-awareness it.edu/security/report-phishing bank.de/sicherheit/about-phishing docs.org/serial-port/setup docs.org/serial-number/find music.org/poker-face/lyrics math.org/probability/roulette-wheel-history ville.fr/ville-de-paris/musees
sport.fr/jeux-olympiques/paris-2024 culture.fr/musee/paris nobel.es/premio-nobel/literatura letras.es/premio-cervantes banque.fr/credit/taux bank.de/kredit/rechner shop.de/rabatt shop.fr/cadeau/noel news.fr/argent/bourse jeux.fr/enfants/jeux
recipes.org/gluten-free/bread recipes.org/best-cheap-dinners travel.org/duty-free/airports news.org/election/winner news.org/2024/trade-deal code.org/click-event/handler code.org/win/api/docs code.org/track/changes
python.org/download/releases kernel.org/pub/linux news.org/uk/pill-shortage news.org/health/contraceptive-pill garden.org/farm-to-table zoo.org/free-entry/monday physics.edu/spin/electrons physics.edu/spin-half/track history.org/monte-carlo-casino-history
essex.ac.uk/courses sussex.ac.uk/history middlesex.edu/admissions wessex.org/archaeology scunthorpe.gov.uk/council penistone.org/walks cockburn.org/town arsenal.com.au/fixtures alphabet.org/about analytics.org/docs shitake.org/mushrooms
news.org/sports/slot-machines-law news.org/casinoroyale.html dictionary.org/bet dictionary.org/crack dictionary.org/popup dictionary.org/nackt wort.de/wette wort.de/nackt mot.fr/pari mot.fr/gagner palabra.es/ganar palabra.es/sexo
shop.org/discount shop.org/coupon/terms shop.org/sale offers.org/jobs games.org/chess games.org/free tracker.org/bugs/112 bugs.org/issue-tracker/open ads.org/policy browser.org/popup-blocker
museum.de/ausstellung/erotik-der-antike theater.de/programm/gewinnspiel theater.fr/rencontre/auteur cine.es/oferta-cultural biblioteca.es/descarga/libro mairie.fr/publicite-legale mairie.fr/loterie univ.fr/cours/remise-a-niveau oper.de/gratis
blog.org/how-to-win-friends blog.org/the-big-deal/with-data blog.org/deal-with-stress blog.org/online/courses/free news.org/loan-of-player news.org/world-cup/win stats.org/win-win/strategy bio.edu/sex-chromosome/x law.org/sex-discrimination/act law.org/same-sex/marriage
""".split()
BAD = """
best-casino.net/bonus online-casinos.biz/win casino.xyz xn--casino.net/casino/online lucky.org/casino-slots slots-jackpot.net/spins poker-betting.org royal-roulette.net/jackpot bet-bonus.biz sportsbook.biz/betting
freebets.net/betting/bonus gambling-jackpot.net slots.biz/gambling win-jackpot.net/slots bonus.biz/betting/win casinos.de/bonus spielhalle.de/glücksspiel wetten.de/sportwetten gewinnspiel.de/wetten glücksspiel.de/wette
apuestas.es/ganar loteria.es/apuestas/lotería casino.es/apuestas paris.fr/pari/gagner loterie.fr/pari pari.fr/gagner/argent casino.fr/jeux xxx.org xxx.biz/videos porn.net/free free-porn.org hd.net/porno/teen tube.biz/xxx/1
pornhub.example.org xvideos.example.net/watch hentai.biz/manga camgirls.biz/live camgirl.net adult-sex.net/videos nude-sex.org escort-adult.net escorts.net/london hookup.net/sex/tonight dating.biz/hookup/adult nude.biz/adult/gallery
sexfilme.de/gratis pornos.de erotik.de/nackt nackt.de/erotik/bilder hurenbock.de sexe.fr/erotique libertin.fr/rencontre/sexe pornographie.fr erotique.fr/rencontres sexo.es/desnuda prostitutas.es/madrid erotico.es/sexo
pornografia.es viagra.biz/buy cheap-viagra.net cialis.net/online viagra-cialis.biz pills.biz/cheap/promo potenzmittel.de/gratis/rabatt warez.net/apps crack-keygen.net/adobe keygen.biz/serial/1 serial-crack.org/windows torrent.biz/crack
cracked.net/torrent warez.biz/torrent raubkopie.de phishing.net/kit hameçonnage.fr payday-loan.biz/loans cheap.biz/loans/payday loans.net/payday/bonus kredit.de/gratis/rabatt credit.fr/argent/gratuit promo.fr/gratuit/gagner
premio.es/ganar/gratis ganar.es/premio gratis.es/descuento/oferta spam.biz/bonus/toplist toplist.net/spam popup.biz/spam/clicks bonus.net/spins/online spins.biz/jackpot win.biz/bonus/winner click.biz/win/bonus deals.biz/coupon/cheap
discount.biz/cheap/pill coupons.net/deals/discounts cheap.net/deal/coupon casino.net/wiki/casino-royale sex.net/adult/education-not poker.net/gambling/online gambling.net/roulette betting.net/odds/slots jackpot.biz/roulette roulette.biz/poker
bets.biz/jackpot adult.net/escort escort.biz/sex/now sex.biz/hookup nude.net/sex/cam torrent.net/keygen serial.net/keygen/free bet.biz/gambling bet.net/jackpot/win bonus.org/gambling/promo betting.org/promo/bonus popup.net/promo/spam
""".split()


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(f"https://{u}", kind) for kind, listed in (("allow", GOOD), ("block", BAD)) for u in listed]
    judged = url_filter.judge(spark.createDataFrame(rows, "url string, wanted string"), RULES[:0]).collect()
    return [(r.url, r.wanted, r.judged.verdict) for r in judged]


def test_precision_and_recall(verdicts):
    assert len(verdicts) >= 200
    blocked = [u for u, _, said in verdicts if said == "block"]
    right = [u for u, wanted, said in verdicts if said == wanted == "block"]
    wrong = sorted(set(blocked) - set(right))
    missed = sorted(u for u, wanted, said in verdicts if wanted == "block" and said == "allow")
    assert len(right) / len(blocked) >= 0.95, wrong
    assert len(right) / len(BAD) >= 0.95, missed


def test_terms_of_different_languages_do_not_add_up(spark):
    urls = ["https://a.org/sexo/erotik", "https://a.org/sexo/erotico", "https://a.de/sexo/erotico", "https://a.de/sexo/erotik/nackt", "https://a.org/sexo/sexo", "https://a.org/free-software-free-software/gambling", "https://a.org/" + "x/" * 200_000 + "casino", None]
    got = [r.judged for r in url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").coalesce(1), []).orderBy("i").collect()]
    assert [g.verdict for g in got] == ["allow", "block", "allow", "block", "allow", "allow", "block", "allow"]
    assert (got[1].strict, got[1].soft, got[1].weight) == (0, 2, 120)
    assert (got[4].soft, got[4].weight) == (1, 0)
