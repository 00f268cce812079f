"""Wording of page categories in EN, DE, FR, IT, ES, NL.

Every block is one table. Terms are separated by commas; a word that ends in ``*`` is a prefix, and terms are
matched as whole words on the match form of ``shopaudit.functions.text.match_form``.
"""
from __future__ import annotations


def terms(block: str) -> list[str]:
    return [" ".join(t.split()) for t in block.replace("\n", " ").split(",") if t.strip()]


# Fixed order: a link falls into the first category that matches.
LEGAL_CATEGORIES = ["imprint", "withdrawal", "terms", "privacy", "accessibility", "cookies"]

# Link text, title and h1 wording per legal category.
LEGAL_TEXT = {
    "imprint": terms("""
        imprint, legal notice, legal information, company information, site notice,
        impressum, anbieterkennzeichnung, mentions legales, informations legales,
        note legali, informazioni legali, aviso legal, informacion legal,
        colofon, juridische informatie, wettelijke informatie"""),
    "withdrawal": terms("""
        right of withdrawal, withdrawal, withdrawal policy, cancellation policy, returns, return policy,
        refund policy, returns and refunds, widerruf*, rucksendung*, retoure*,
        droit de retractation, retractation, retours, politique de retour,
        recesso, diritto di recesso, resi, politica di reso,
        desistimiento, derecho de desistimiento, devoluciones, politica de devoluciones,
        herroeping*, retourneren, retourbeleid, retouren"""),
    "terms": terms("""
        terms, terms and conditions, terms of service, terms of sale, general terms,
        agb, allgemeine geschaftsbedingungen, cgv, cgu, conditions generales*,
        termini e condizioni, condizioni generali*, condizioni di vendita,
        terminos y condiciones, condiciones generales*, algemene voorwaarden, voorwaarden"""),
    "privacy": terms("""
        privacy, privacy policy, privacy notice, data protection, datenschutz*,
        confidentialite, politique de confidentialite, donnees personnelles,
        informativa sulla privacy, informativa privacy,
        privacidad, politica de privacidad, proteccion de datos, privacybeleid, privacyverklaring"""),
    "accessibility": terms("""
        accessibility, accessibility statement, barrierefreiheit*, erklarung zur barrierefreiheit,
        accessibilite, declaration d'accessibilite, accessibilita, dichiarazione di accessibilita,
        accesibilidad, declaracion de accesibilidad, toegankelijkheid*"""),
    "cookies": terms("""
        cookie policy, cookies policy, cookie notice, cookies, cookie richtlinie*, cookie hinweis*,
        politique de cookies, politique relative aux cookies, informativa sui cookie,
        politica de cookies, cookiebeleid, cookieverklaring"""),
}

# URL path wording per legal category.
LEGAL_SLUGS = {
    "imprint": terms("""
        imprint, legal notice, legal info*, impressum, mentions legales,
        note legali, informazioni legali, aviso legal, colofon"""),
    "withdrawal": terms("""
        withdraw*, return*, refund*, cancellation policy, widerruf*, rucksendung*, retoure*,
        retractation, retours, recesso, resi, desistimiento, devolucion*,
        herroeping*, retourneren, retourbeleid"""),
    "terms": terms("""
        terms*, agb, cgv, cgu, conditions generales*, termini*, condizioni*, terminos*,
        condiciones*, algemene voorwaarden, voorwaarden"""),
    "privacy": terms("privacy*, datenschutz*, confidentialite, privacidad, privacybeleid, privacyverklaring"),
    "accessibility": terms("""
        accessibility*, a11y, barrierefreiheit*, accessibilite, accessibilita, accesibilidad, toegankelijkheid*"""),
    "cookies": terms("cookie policy, cookies, cookie richtlinie*, cookiebeleid, cookieverklaring"),
}

# Account, cart and checkout wording (text, then URL path).
ACCOUNT_TEXT = terms("""
    my account, account, log in, login, sign in, my orders,
    mein konto, kundenkonto, anmelden, meine bestellungen, mon compte, connexion, se connecter, mes commandes,
    il mio account, accedi, i miei ordini, mi cuenta, iniciar sesion, mis pedidos,
    mijn account, inloggen, mijn bestellingen""")
ACCOUNT_SLUGS = terms("""
    account*, login, signin, sign in, mein konto, kundenkonto, konto,
    mon compte, il mio account, mi cuenta, mijn account, orders""")
CART_TEXT = terms("""
    cart, shopping cart, basket, shopping bag,
    warenkorb, panier, carrello, carrito, cesta, winkelwagen, winkelmand""")
CART_SLUGS = terms("cart, carts, basket, warenkorb, panier, carrello, carrito, cesta, winkelwagen, winkelmand")
CHECKOUT_TEXT = terms("""
    checkout, check out, zur kasse, kasse, passer commande, paiement,
    cassa, procedi all'acquisto, finalizar compra, tramitar pedido, afrekenen""")
CHECKOUT_SLUGS = terms("checkout*, kasse, cassa, finalizar compra, afrekenen")

# Path segments that announce a product page.
PRODUCT_SEGMENTS = terms("""
    product, products, p, item, items, shop, produkt, produkte, artikel, produit, produits, article,
    prodotto, prodotti, producto, productos, producten""")

# Add-to-cart buttons and headings of cart and checkout pages.
ADD_TO_CART = terms("""
    add to cart, add to bag, add to basket, buy now, in den warenkorb, jetzt kaufen,
    ajouter au panier, acheter maintenant, aggiungi al carrello, acquista ora,
    anadir al carrito, anadir a la cesta, comprar ahora,
    in winkelwagen, in winkelmand, toevoegen aan winkelwagen, nu kopen""")
CART_HEADINGS = terms("""
    your cart, shopping cart, your basket, your bag, warenkorb, ihr warenkorb, votre panier, panier,
    il tuo carrello, carrello, tu carrito, carrito, cesta, winkelwagen, je winkelwagen""")
CHECKOUT_HEADINGS = terms("""
    checkout, kasse, bestellung abschliessen, paiement, finaliser la commande,
    cassa, pagamento, finalizar compra, pago, afrekenen""")

# Path extensions of links that are never pages, and of downloadable documents.
ASSET_EXTENSIONS = terms("""
    pdf, doc, docx, odt, rtf, txt, xls, xlsx, csv, zip, jpg, jpeg, png, gif, webp, avif, svg, ico,
    mp4, webm, mp3, css, js, json, xml""")
DOCUMENT_EXTENSIONS = terms("pdf, doc, docx, odt, rtf")
