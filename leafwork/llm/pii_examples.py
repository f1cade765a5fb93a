"""Labelled spans for the personal-information model: made from ordinary names, numbering schemes and turns of phrase of nine languages.

Nothing here was taken from a table. Names are common given names and surnames or are put together from random syllables, numbers
follow forms that countries use, and the sentences around them are built from frequent words and random letters, so that the
model has to go by shape and surroundings. ``strange=True`` draws from parts kept out of training, for an honest figure.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "address", "name")

# Common given names and surnames (general knowledge).
GIVEN = {
    "en": "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Nancy Daniel Lisa Matthew Betty Anthony Helen Mark Sandra Donald Ashley Steven Ruth Paul Emily Andrew Alice Joshua Nora Kenneth Carol Kevin Clara Brian Irene George Judith Edward Laura Ronald Grace Simon Diana Hugh Julia Philip Rose Oscar Tessa Walter Ellen Gordon Anne Martin Joan Edwin",
    "de": "Peter Hans Ursula Klaus Monika Wolfgang Petra Jürgen Sabine Dieter Renate Manfred Helga Uwe Karin Günter Brigitte Andreas Ingrid Stefan Erika Bernd Gisela Heike Rainer Silke Lothar Ulrike Konrad Jörg Anke Matthias Greta Frank Elke Holger Birgit Axel Jana",
    "fr": "Jean Marie Pierre Françoise Michel Monique André Catherine Philippe Nathalie Alain Isabelle Jacques Sylvie Bernard Anne Louis Martine Daniel Nicole Claude Hélène Yves Odile Benoît Chantal René Thierry Mireille Gérard Agnès Luc Paola Étienne Zoé",
    "es": "Antonio María José Carmen Francisco Ana Juan Isabel Manuel Dolores Pedro Pilar Jesús Teresa Ángel Rosa Javier Cristina Miguel Lucía Rafael Elena Ramón Marta Andrés Rocío Tomás Inés Jorge Nieves Álvaro Elvira Óscar Silvia",
    "pt": "João Maria António Ana José Isabel Manuel Paula Carlos Teresa Luís Beatriz Paulo Joana Pedro Inês Rui Graça Duarte Marta Nuno Catarina Tiago Sofia Dário Rita",
    "it": "Giuseppe Maria Antonio Anna Giovanni Rosa Francesco Giulia Mario Elena Luigi Chiara Marco Paola Franco Laura Carlo Silvia Roberto Livia Guido Ettore Renzo Sandro Francesca Lucia",
    "nl": "Jan Maria Piet Johanna Kees Anna Hendrik Wilhelmina Willem Elisabeth Joost Lotte Bram Femke Sander Anneke Wouter Marijke Gijs Hanneke Daan Sanne Ruud Ilse",
    "ru": "Александр Елена Сергей Ольга Владимир Наталья Андрей Татьяна Алексей Ирина Дмитрий Светлана Николай Мария Иван Анна Михаил Галина Павел Людмила Игорь Вера Олег Нина Юрий Зоя Роман Лидия Борис Софья Виктор Тамара Пётр Антон",
}
SURNAMES = {
    "en": "Smith Jones Taylor Brown Williams Wilson Johnson Davies Robinson Wright Thompson Evans Walker White Roberts Green Hall Wood Jackson Clarke Harrison Cooper Ward Morris King Baker Turner Hughes Parker Cook Bell Shaw",
    "de": "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hofmann Hartmann Lange Krause",
    "fr": "Martin Bernard Dubois Thomas Robert Richard Petit Durand Leroy Moreau Simon Laurent Lefebvre Michel Garcia David Bertrand Roux Vincent Fournier Morel Girard Lambert Dupont Rousseau",
    "es": "García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz Moreno Álvarez Muñoz Romero Alonso Gutiérrez Navarro Torres",
    "pt": "Silva Santos Ferreira Pereira Oliveira Costa Rodrigues Martins Jesus Sousa Fernandes Gonçalves Gomes Lopes Marques Alves Almeida Ribeiro Pinto Carvalho Teixeira",
    "it": "Rossi Russo Ferrari Esposito Bianchi Romano Colombo Ricci Marino Greco Bruno Gallo Conti Costa Giordano Mancini Rizzo Lombardi Moretti",
    "nl": "Jansen Vries Berg Bakker Visser Smit Meijer Boer Mulder Groot Bos Vos Peters Hendriks Leeuwen Dekker Brouwer Wit Dijkstra",
    "ru": "Иванов Смирнова Кузнецов Попова Васильев Петрова Соколов Михайлова Новиков Фёдорова Морозов Волкова Алексеев Лебедева Семёнов Егорова Павлов Козлова Степанов Орлова Никитин Зайцева Достоевский Невская Шевченко",
}
# Names of people in Chinese: surnames and characters of given names.
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林郑谢罗梁宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严"
HAN_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华文玉兰建国志梅红春海波宁倩丹萍鑫飞雪慧颖琳佳浩宇轩晨欣怡婷"
CITIES = "London Paris Berlin Madrid Rome Lisbon Vienna Prague Leeds Hamburg Lyon Sevilla Porto Milano Utrecht Bristol Bremen Dijon Toledo Braga Torino Leiden Oxford Kassel Nantes York Bonn".split()
CITIES_RU = "Москве Казани Твери Рязани Омске Самаре Туле Пскове Калуге Перми".split()

# Frequent words: openers of sentences (capitalised there), and words within them.
OPENERS = {
    "en": "The A In At On Of Near Each Every One Both If While Since For From By And But Or To See Why How Whoever Do Compare There Until Unless Although Because After Before As It Under During Not Only Call Write Please We He She This That These Some Most Nobody Many Around Towards Without According Readers Visitors When Where Between Nothing Yours Our Turn Above Below Once Even Throughout Inside",
    "de": "Der Die Das Ein Eine In Im Bei Von Vom Aus Auf An Am Nach Seit Vor Unter Über Mit Ohne Für Gegen Durch Wer Wenn Weil Obwohl Während Als Und Aber Oder Jede Jeder Jedes Nicht Bitte Wir Sie Er Es Diese Dieser Viele Nur Auch Zwischen Zur Zum Man Bis Ob Wie Warum Leser Laut Trotz",
    "fr": "Le La Les Un Une Des De Du À Au En Dans Sur Sous Près Chez Pour Par Avec Sans Depuis Pendant Après Avant Quand Si Comme Chaque Cette Ce Ces Mais Et Ou Nous Vous Il Elle On Selon Entre Vers Puisque Parce Lorsque Tandis Bien Aucun Personne Toute Pourquoi Jusque Autant",
    "es": "El La Los Las Un Una De Del Al En A Con Sin Por Para Desde Hasta Según Entre Sobre Bajo Cada Este Esta Ese Y O Pero Si Cuando Como Mientras Aunque Porque Después Antes Nadie Todo Nuestro Lo Se Durante Tras Cerca Ni Quien Junto",
    "pt": "O A Os As Um Uma De Do Da Dos Em No Na Com Sem Por Para Desde Até Segundo Entre Sobre Sob Cada Este Esta Esse E Ou Mas Se Quando Como Enquanto Embora Porque Depois Antes Ninguém Todo Nosso Durante Perto Ao À Das Nem Quem Junto",
    "it": "Il Lo La I Gli Le Un Una Di Del Della A Al Alla In Nel Con Senza Per Da Dal Fino Secondo Tra Su Sotto Ogni Questo Questa E O Ma Se Quando Come Mentre Benché Perché Dopo Prima Nessuno Tutto Durante Presso Dei Delle Chi Vicino Anche",
    "nl": "De Het Een In Op Bij Van Uit Aan Na Sinds Voor Onder Over Met Zonder Tegen Door Wie Als Omdat Hoewel Terwijl En Maar Of Elke Elk Niet Wij Zij Hij Deze Dit Veel Alleen Ook Tussen Men Tot Hoe Waarom Volgens Ondanks Niemand Lezers",
    "ru": "В Во На Из Но А И К С У О Об От До По За Под Над При Для Без Через Между После Перед Когда Если Пока Хотя Чтобы Как Где Кто Что Это Этот Эта Каждый Каждая Все Никто Не Один Мы Вы Он Она Они Около Время Весной Летом Осенью Зимой Почему Согласно Вблизи",
}
WORDS = {
    "en": "the a of to and in is that it was for on are with as his they be at one have this from or had by but what some we can out other were all there when up use your how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did sound no most people over know water than call first who may down side been now find any new work part take get place made live where after back little only round man year came show every good me give our under name",
    "de": "und die der in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei unter wenn neue alte große kleine lange erste zweite",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux été cette mais comme tout nous sa fait être deux même aussi leur bien peut ces sans autres après temps très grande petite vieille nouvelle",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros vieja nueva grande",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos velha nova grande",
    "it": "di a da in con su per tra fra il lo la i gli le un una e o ma se che non si è sono ha hanno come più anche dopo prima molto questo quella suo loro dove quando ogni tutto nuova vecchia grande piccola",
    "nl": "de van het een en in is dat op te zijn met voor niet aan er om ook als door maar naar bij uit nog over tot hebben worden wordt kan meer dan die deze onder oude nieuwe grote kleine lange eerste",
    "ru": "и в не на что с по это как к но из у за от о так же для бы все или если уже при чем было до во она они мы вы он над под без через между новый старый большой малый первый второй каждый лист том",
}
HAN_WORDS = "的 一份 这份 那份 旧 新 在 上 下 中 有 没有 说明 记录 保存 每 本 张 个 房间 书 纸 信 地图 目录 编号 年 月 窗 墙 门 和 与 被 了 是 由 对 从 到 里 外".split()
NOUNS_DE = "Haus Buch Tisch Karte Seite Blatt Stadt Mappe Rechnung Brücke Treppe Akte Tür Wand Fenster Jahr Tag Zeit Papier Liste Sammlung Tinte Kiste Uhr Wagen Mühle Farbe Ordnung Prüfung Ausgabe".split()

# How a number or a person is announced (general knowledge).
LABELS = {
    "email": "E-mail: |Email: |e-mail |Mail: |E-Mail: |Courriel : |Mél : |Correo: |Correo electrónico: |Correio: |Posta elettronica: |mailto:|Почта: |Эл. почта: |邮箱：|电子邮件：|Write to |write to |Contact |Replies to |Send it to |Bitte an |Schreiben Sie an |Écrire à |Réponse à |Escriba a |Escreva para |Scrivere a |Schrijf naar |Mail naar |Пишите на |请写信至 |请联系 |Kontakt: |Contatto: |Contacto: ",
    "phone": "Tel. |Tel.: |Phone |Phone: |Telephone: |Fax |Fax: |Mobile: |mobile |Cell: |Call |call |Ring |Reach us on |can be reached on |Telefon |Telefon: |Mobil: |Handy: |Rufnummer: |Erreichbar unter |Téléphone : |Tél. : |Portable : |Appeler le |Télécopie : |Teléfono: |Móvil: |Llame al |Telefone: |Telemóvel: |Ligue para o |Telefono: |Cellulare: |Chiamare lo |Telefoon: |Mobiel: |Bel |Телефон: |Тел. |Факс: |Звоните |电话：|手机：|传真：|联系电话 |请致电 ",
    "id_number": "Passport |Passport no. |Passport number: |ID: |ID no. |ID number |Identity card |identity card no. |The identity card bears the number |Nat. ID: |National ID |Tax number |Tax ID: |tax reference |Social insurance number: |Social security number |Insurance no. |National Insurance: |SSN |Personalausweis Nr. |Ausweisnummer |Ausweis-Nr. |Reisepass |Reisepassnummer: |Steuernummer: |Steuer-ID |Sozialversicherungsnummer: |Versicherungsnummer |Passeport |Passeport n° |Carte d'identité n° |Numéro fiscal : |N° de sécurité sociale : |Pasaporte |Pasaporte n.º |DNI |DNI: |NIE |NIF: |Número de la Seguridad Social: |Passaporte n.º |Bilhete de identidade |Cartão de cidadão |Contribuinte n.º |Segurança social: |Passaporto n. |Carta d'identità n. |Codice fiscale |Tessera sanitaria |Paspoort |Paspoortnummer: |BSN |BSN: |Identiteitskaart |Burgerservicenummer |Паспорт |Паспорт № |ИНН |ИНН: |СНИЛС |Номер удостоверения: |Удостоверение личности |证件号：|身份证号：|护照 |护照号码：|税号：|社保号：",
    "address": "He lives at |She lives at |lives at |Address: |Home address: |Resident at |The parcel went to |Send it to |Return the box to |Visit us at |Wohnhaft |wohnhaft |Anschrift: |Adresse: |Wohnt in der |Das Paket ging an |Demeurant |Demeure |Adresse : |Habite au |Domicilié |Le colis est parti au |Dirección: |Vive en |Domicilio: |Residente en |Morada: |Mora na |Residente em |A encomenda foi para |Indirizzo: |Abita in |Residente in |Il pacco è andato in |Adres: |Woont in de |Wonend aan de |Het pakket ging naar |",
    "name": "Dear |Witness: |Reader: |Signed: |cc: |Attn: |Author: |Please ask for |We spoke to |checked by |according to |According to Mrs |Mr |Mrs |Ms |Dr. |Prof. |Yours sincerely, |Kind regards,\n|Herr |Frau |Herrn |Frau Dr. |Ansprechpartner: |Zeuge: |Leser: |Geprüft von |Mit freundlichen Grüßen, |Liebe |Lieber |Sehr geehrter Herr |Laut Frau |M. |Mme |Madame |Monsieur |Cher |Chère |Vérifié par |Témoin : |Lecteur : |Cordialement, |Selon |cc: M. |Señor |Señora |Sr. |Sra. |Don |Estimado |Estimada |Revisado por |Verificado por |Testigo: |Lector: |Atentamente, |Según la señora |Senhor |Senhora |Caro |Cara |Testemunha: |Leitor: |Atenciosamente, |Segundo o senhor |Signor |Signora |Sig. |Sig.ra |Dott. |Gentile |Controllato da |Testimone: |Lettore: |Cordiali saluti, |Secondo la signora |Meneer |Mevrouw |De heer |Beste |Nagekeken door |Getuige: |Lezer: |Met vriendelijke groet, |Volgens mevrouw |Господин |Госпожа |Г-н |Г-жа |Уважаемый |Уважаемая |Проверил |Проверила |Свидетель: |Читатель: |С уважением, |По словам г-жи |Ключ у г-на |Обратитесь к ",
    "han_name": "联系人：|读者：|证人：|姓名：|由|请找|尊敬的|签名：",
}
AFTER_NAME = {
    "en": " signed the sheet.| has the key.| asked for a copy.| wrote this.| kept the other half.| about the matter.|,\n\n| came in.|.| asks again.", "de": " hat den Schlüssel.| bittet um eine Kopie.| hat unterschrieben.|,\n|.| schrieb dies.| nannte keinen Grund.",
    "fr": " a signé la feuille.| garde la clé.| demande une copie.|,\n|.| a écrit ceci.", "es": " firmó la hoja.| tiene la llave.| pide una copia.|,\n|.| escribió esto.", "pt": " assinou a folha.| tem a chave.| pede uma cópia.|,\n|.", "it": " ha firmato il foglio.| ha la chiave.| chiede una copia.|,\n|.",
    "nl": " heeft het blad getekend.| heeft de sleutel.| vraagt een kopie.|,\n|.", "ru": " подписал лист.| подписала лист.| просит копию.|,\n|.| написал это.", "zh": "签了字。|提供了副本。|说没有丢失。|。|先生来过。|女士，",
}
STREETS = {
    "en": ["{n} {s} Street", "{n} {s} Road", "{n} {s} Lane", "{n} {s} Avenue", "{n} {s} Court", "{n} {s} Terrace", "{n} {s} Quay", "{n} {s} St", "{n} {s} Rd", "{n} {s} Drive", "{n} {s} Square", "{n} {s} Close", "{n} {s} Ave"],
    "de": ["{s}straße {n}", "{s}platz {n}", "{s}weg {n}", "{s}gasse {n}", "{s}allee {n}", "{s}ring {n}", "{s}ufer {n}", "{s}damm {n}", "{s}str. {n}"], "fr": ["{n}, rue {s}", "{n}, quai {s}", "{n} bis, rue {s}", "{n}, impasse {s}", "{n}, avenue {s}", "{n} rue de {s}", "{n}, place {s}", "{n}, boulevard {s}", "{n}, chemin {s}"],
    "es": ["calle {s}, {n}", "avenida {s}, {n}", "plaza {s}, {n}", "paseo {s}, {n}", "Calle {s} {n}", "camino {s}, {n}"], "pt": ["Rua {s}, n.º {n}", "Travessa {s}, n.º {n}", "Avenida {s}, n.º {n}", "Largo {s}, {n}", "Rua {s}, {n}", "Praça {s}, n.º {n}"],
    "it": ["Via {s}, {n}", "Corso {s}, {n}", "Piazza {s}, {n}", "Viale {s} {n}", "Via {s} {n}", "Vicolo {s}, {n}"], "nl": ["{s}straat {n}", "{s}laan {n}", "{s}kade {n}", "{s}gracht {n}", "{s}plein {n}", "{s}weg {n}", "{s}singel {n}"], "ru": ["ул. {s}, д. {n}", "улица {s}, {n}", "пр. {s}, д. {n}", "переулок {s}, {n}"],
}
# Forms of numbers: # a digit, @ a capital letter.
PHONES = "+44 20 #### ####|020 #### ####|0#### ######|+1 ### ### ####|(###) ###-####|###-###-####|###.###.####|+33 # ## ## ## ##|0# ## ## ## ##|+49 ## ########|+49 (0)## #####-###|0049 ## ########|0## ##### ###|+34 ### ## ## ##|9## ### ###|+351 ## ### ## ##|+39 0# #### ####|0# #######|+31 ## ### ## ##|0##-#######|+7 ### ###-##-##|8 (###) ###-##-##|+86 ### #### ####|1## #### ####|+## ### ### ####|(0##) ### ## ##|+44 (0)#### ######|0##/#######".split("|")
IDS = "########@|@#######|@@######|@@ ## ## ## @|@@ ## ## ## ## @|### ### ###|####-####-##|######/####|###########|### ## ####|###-##-####|##########|#########|## ### ### ###|##.##.##-###.##|##/###/#####|@########|########-@|######-####|# ## ## ## ### ### ##|#### ######|###-###-### ##|#### #### ####|##############|@@@ ### ###|########|##-#######|#####-#####".split("|")
NOISE = {
    "en": "See pages ###-####.|page ##|Batch ####-####-##, box ##.|Invoice no. ####-##|Plate #### #### ####.|Version #.#.##, build #.|Order @##### was cancelled.|Shelf mark MS ####/##.|Dated ##.##.19##.|Total: ####.## for ## reels.|Ratio @@ ## dpi, setting #.|Unit @#-#### covers it.|Lot ####-####-##|Of the ### copies, |(see item ###)|Chapter ##|on sheet ###|from 19##-## to 20##|ISBN 978-#-##-######-#|at ##:##|No. ####|#.##|###.|- ## -|reel ########|negative ### ### ###|weight ####.## kg|Figure #-##|Serial @@######|Item ###-##-###|order no. ##########|Price £##.##|##/##/19##|a ratio of # @ ##|set @ ### rpm",
    "de": "Rechnung Nr. ####-##|Charge ####-####-##.|Seite ###|Signatur MS ####/##|vom ##.##.19##|Von den ### Blättern |Bestellung @#####|Band ##, Blatt ###|Los ########|Nr. ### ### ###", "fr": "Facture n° ####-##|Lot ####-####-##.|page ###|cote MS ####/##|le ## mai 19##|Des ### feuilles |Commande @#####|planche ## ## ## ##", "es": "Factura n.º ####-##|Lote ####-####-##.|página ###|Signatura MS ####/##|De las ### hojas |Pedido @#####|el ##.##.19##", "pt": "Fatura n.º ####-##|Lote ####-####-##.|página ###|Cota MS ####/##|Das ### folhas |Encomenda @#####", "it": "Fattura n. ####-##|Lotto ####-####-##.|pagina ###|Segnatura MS ####/##|Dei ### fogli |Ordine @#####", "nl": "Factuur nr. ####-##|Partij ####-####-##.|bladzijde ###|Signatuur MS ####/##|Van de ### bladen |Bestelling @#####", "ru": "Счёт № ####-##|Партия ####-####-##.|страница ###|Шифр MS ####/##|Из ### листов |Заказ @#####|от ##.##.19##", "zh": "发票号 ####-##|批次 ####-####-##。|见第##-###页。|馆藏号 MS ####/##。|共###张|第##页|订单 @#####",
}
PEOPLE = {
    "en": "Readers from|Visitors from|People in|Friends near|Guests at|Letters from|Nobody at|Everyone in", "de": "Leser aus|Besucher aus|Gäste in|Briefe aus|Niemand in|Blätter aus", "fr": "Lecteurs de|Visiteurs de|Personne à|Lettres de|Gens de", "es": "Lectores de|Visitantes de|Nadie en|Cartas de|Gente de",
    "pt": "Leitores de|Visitantes de|Ninguém em|Cartas de|Gente de", "it": "Lettori di|Visitatori di|Nessuno a|Lettere da|Gente di", "nl": "Lezers uit|Bezoekers uit|Niemand in|Brieven uit|Mensen in", "ru": "Читатели из|Гости из|Никто в|Письма из|Люди в", "zh": "|",
}
FIRMS = "{s} & Sons Ltd|{s} Paper Company|{s} GmbH|{s} Papier GmbH|{s} et Fils SARL|Papelera {s} SA|Tipografia {s} srl|Gráfica {s} Lda|{s} Papier BV|{s} & Co|{s} Brothers Inc|Imprimerie {s}|{s} Library|{s} Bridge|{s} Museum|{s} University|Banco {s}|{s} Verlag|Drukkerij {s}|Hotel {s}".split("|")
TITLE_WORDS = "Annual Report|New Catalogue|General Index|Table of Contents|Old Records|Part Two|Field Notes|House Rules|City Archive|Reading Room|Minutes of the Meeting|Opening Hours|Neue Ordnung|Alte Karten|Nouvelle Série|Nueva Serie|Nuova Serie|Новый Каталог|Старый Дом".split("|")

_ON, _VOWEL, _CODA = "b br c ch cl d dr f fl g gr h j k kl l m n p pr r s sch sh sl st t th tr v w z".split(), "a e i o u a e i o ai ie ou ee".split(), ["", "", "", "l", "n", "r", "s", "t", "m", "d", "rk", "nd", "st", "ld", "ck", "x", "nn", "rs"]
_ON_RU, _VOWEL_RU, _CODA_RU = "б в г д ж з к л м н п р с т ф х ч ш бр вл гр кр ст тр".split(), "а е и о у ы я".split(), ["", "", "л", "н", "р", "с", "к", "м", "т"]
_ENDS_RU = "ов ова ев ева ин ина ский ская енко ко ых ий ая ич ук".split()


_TITLED = re.compile(r"(?:Mr|Mrs|Ms|Dr\.|Prof\.|Herrn?|Frau|M\.|Mme|Madame|Monsieur|[Ss]eñora?|Sra?\.|Don|[Ss]enhora?|[Ss]ignora?|Sig\.(?:ra)?|Dott\.|Meneer|[Mm]evrouw|heer|Господин|Госпожа|[Гг]-(?:н|жа|жи|на)) $")


class Maker:
    def __init__(self, seed: int, strange: bool = False):
        self.r, self.strange = random.Random(seed), strange
        keep = (lambda i: i % 5 == 0) if strange else (lambda i: i % 5 != 0)
        part = lambda xs: [x for i, x in enumerate(xs) if keep(i)] or list(xs)
        self.given = {k: part(v.split()) for k, v in GIVEN.items()}
        self.surnames = {k: part(v.split()) for k, v in SURNAMES.items()}
        self.onset = part(_ON) if strange else _ON

    def pick(self, xs):
        return xs[int(self.r.random() * len(xs))]

    def digits(self, form: str) -> str:
        return re.sub("[#@]", lambda m: self.pick("0123456789") if m[0] == "#" else self.pick("ABCDEFGHJKLMNPQRSTUVWXYZ"), form)

    def syllables(self, n: int, ru: bool = False) -> str:
        return "".join(self.pick(_ON_RU if ru else self.onset) + self.pick(_VOWEL_RU if ru else _VOWEL) + self.pick(_CODA_RU if ru else _CODA) for _ in range(n))

    def surname(self, lang: str) -> str:
        x = self.r.random()
        if x < 0.3:
            s = self.pick(self.surnames[lang])
        elif lang == "ru":
            s = self.syllables(1 + int(self.r.random() * 2), True).capitalize() + self.pick(_ENDS_RU)
        else:
            s = self.syllables(2 + int(self.r.random() * 2)).capitalize()
        if x > 0.94:
            t = self.surname(lang)
            s = f"{s}-{t}" if "-" not in t else s
        return s

    def place(self, lang: str) -> str:
        if lang == "ru":
            return self.pick(CITIES_RU) if self.r.random() < 0.4 else self.syllables(2, True).capitalize() + self.pick(["ске", "граде", "ове", "ино", "е"])
        return self.pick(CITIES) if self.r.random() < 0.25 else self.syllables(2 + int(self.r.random() * 2)).capitalize() + self.pick(["", "", "ton", "burg", "ville", "field", "mouth", "stad", "holm", "dale", "port", "by"])

    def name(self, lang: str, single: bool) -> str:
        s = self.surname(lang)
        if single:
            return s.upper() if self.r.random() < 0.05 else s
        g = self.pick(self.given[lang]) if self.r.random() < 0.85 else self.syllables(2, lang == "ru").capitalize()
        m = self.pick("АБВГДЕЗИКЛМНОПРСТ" if lang == "ru" else "ABCDEFGHIJKLMNOPRSTVW")
        x = self.r.random()
        n = f"{g} {s}" if x < 0.52 else f"{s}, {g}" if x < 0.66 else f"{g[0]}. {s}" if x < 0.82 else f"{g} {m}. {s}" if x < 0.92 else f"{g[0]}. {m}. {s}" if x < 0.94 else f"{s} {g[0]}." if x < 0.955 else f"{s}, {g[0]}."
        if self.r.random() < 0.1:
            n = n.upper()
        return n.replace(" ", "\n", 1) if self.r.random() < 0.05 else n

    def email(self) -> str:
        a, b = self.syllables(2), self.pick(self.given[self.pick(["en", "de", "fr", "it"])]).lower()
        b = b.encode("ascii", "ignore").decode() or "jo"
        local = self.pick([f"{b}.{a}", f"{a}_{self.digits('##')}", "info", "office", "reading.room", "sales", "no-reply", f"{b}+list", f"{b[0]}{a}", f"{a}-{b}", f"{b}_{a}", f"{b.title()}.{a.title()}", f"{a}{self.digits('##')}"])
        at, dot = self.pick([("@", ".")] * 7 + [("(at)", "(dot)"), (" [at] ", "."), (" @ ", "."), ("＠", "."), ("[at]", "[dot]"), (" (at) ", " (dot) ")])
        host = self.pick([self.syllables(2), f"{self.syllables(2)}-{self.syllables(1)}", "example", f"{self.syllables(2)}{dot}mail", f"mail{dot}{self.syllables(2)}", f"{self.place('en').lower()}-archive"])
        return local + at + host + dot + self.pick("com org net test example invalid de fr es it nl ru co.uk edu".split())

    def address(self, lang: str) -> str:
        if lang == "ru":
            s = self.syllables(2, True).capitalize() + self.pick(["ская", "ова", "а"])
        else:
            s = self.pick(self.surnames[lang]) if self.r.random() < 0.3 else self.syllables(1 + int(self.r.random() * 2)).capitalize() + self.pick(["", "", "t", "n", "ls"])
        n = str(1 + int(self.r.random() ** 2 * 320)) + self.pick(["", "", "", "", "a", "b", "c", "d", "B"])
        v = self.pick(STREETS[lang]).format(n=n, s=s)
        return v.replace(" ", "\n", 1) if self.r.random() < 0.04 else v

    def value(self, kind: str, lang: str) -> str:
        base = "en" if lang == "zh" else lang
        if kind == "email":
            return self.email()
        if kind == "phone":
            return self.digits(self.pick(PHONES))
        if kind == "id_number":
            return self.digits(self.pick(IDS))
        return self.address(base)

    def words(self, lang: str, n: int) -> str:
        if lang == "zh":
            return "".join(self.pick(HAN_WORDS) if self.r.random() < 0.6 else chr(0x4E00 + int(self.r.random() ** 2 * 0x5000)) for _ in range(n))
        out = []
        for _ in range(n):
            x = self.r.random()
            w = self.pick(WORDS[lang].split()) if x < 0.5 else self.syllables(1 + int(self.r.random() * 3), lang == "ru")
            if lang == "de" and x > 0.7:
                w = self.pick(NOUNS_DE) if x > 0.85 else w.capitalize()
            elif x > 0.97:
                w = self.place(lang)
            elif x > 0.955:
                w = self.digits(self.pick(["#", "##", "###", "19##"]))
            out.append(w + ("," if self.r.random() < 0.06 else ""))
        return " ".join(out)

    def background(self, lang: str) -> list[tuple[str, str]]:
        """A sentence or line without anything personal."""
        x = self.r.random()
        if x < 0.3:
            return [(self.digits(self.pick(NOISE[lang if self.r.random() < 0.6 else "en"].split("|"))), "")]
        if x < 0.36 and lang != "zh":
            firm = self.pick(FIRMS).format(s=self.surname("en" if lang == "ru" else lang))
            return [(self.pick(["Printed by ", "The ", "Gedruckt bei ", "Imprimé chez ", "Impreso en ", "Stampato da ", "Gedrukt bij ", "Impresso na ", "by ", "Sold to ", "The mill at ", "bei "]) + firm + self.pick([".", " sent samples.", " is closed.", ","]), "")]
        if x < 0.41:
            t = self.pick(TITLE_WORDS)
            return [(t.upper() if self.r.random() < 0.5 else t, "")]
        if lang == "zh":
            part = lambda: self.pick(["", "", "", self.digits("第##页，"), self.digits("共###张，"), "，", "，"]) + self.words(lang, 3 + int(self.r.random() * 6))
            return [(part() + self.pick(["，", "，", self.digits("，共##张，")]) + part() + self.pick(["。", "。", "，" + part() + "。"]), "")]
        op = self.pick(OPENERS[lang].split())
        y = self.r.random()
        if y < 0.07:
            s = f"{self.pick(PEOPLE[lang].split('|'))} {self.place(lang)} {self.words(lang, 5)}"
        elif y < 0.11:
            w = self.words(lang, 7).split(" ")
            k = int(self.r.random() * len(w))
            if len(w[k]) > 3:
                w[k] = w[k][:1] + self.pick("@013!|5") + w[k][2:]
            s = f"{op} {' '.join(w)}"
        elif y < 0.15:
            s = f"{op} {self.words(lang, 3)} ({self.pick(['see', 'see item', 'cf.', 'siehe', 'vgl.', 'voir', 'véase', 'ver', 'vedi', 'zie', 'см.'])} {self.digits('###')}) {self.words(lang, 4)}"
        elif y < 0.19 and lang == "de":
            s = f"{op} {self.words(lang, 2)} {self.syllables(2)}e {self.pick(NOUNS_DE) if self.r.random() < 0.5 else self.syllables(2).capitalize()}"
        elif y < 0.22:
            s = f"{op} {self.words(lang, 3)} {self.pick(['pages', 'pp.', 'páginas', 'pagine', 'Seiten', 'pages', 'стр.', 'bladzijden'])} {self.digits(self.pick(['##-##', '##-####', '###-###']))}"
        elif y < 0.34:
            s = f"{op} {self.place(lang)}{self.pick([', ', ' ', ', '])}{self.words(lang, 4 + int(self.r.random() * 6))}"
        elif y < 0.42:
            s = f"{op} {self.words(lang, 2)} {self.pick({'de': ['in', 'bei', 'aus'], 'fr': ['à', 'près de', 'de'], 'es': ['en', 'de', 'cerca de'], 'it': ['a', 'da', 'di'], 'pt': ['em', 'de', 'perto de'], 'nl': ['in', 'bij', 'uit'], 'ru': ['в', 'из', 'близ']}.get(lang, ['in', 'at', 'near', 'from']))} {self.place(lang)} {self.words(lang, 4)}"
        else:
            s = f"{op} {self.words(lang, 5 + int(self.r.random() * 9))}"
        if self.r.random() < 0.06:
            s = f"{1 + int(self.r.random() * 60)}. {s} | {self.words(lang, 3)} | {self.digits('##')}"
        return [(s + self.pick([".", ".", ".", "?", ";", ""]), "")]

    def statement(self, lang: str) -> list[tuple[str, str]]:
        """Text around something personal: (text, kind) pieces, kind empty outside."""
        kind = self.pick(("email", "phone", "phone", "id_number", "id_number", "address", "address", "name", "name", "name", "name", "name"))
        if kind == "name" and lang == "zh" and self.r.random() < 0.4:
            n = self.pick(HAN_SURNAMES) + "".join(self.pick(HAN_GIVEN) for _ in range(1 + int(self.r.random() * 2)))
            return [(self.pick(LABELS["han_name"].split("|")), ""), (n, "name"), (self.pick(AFTER_NAME["zh"].split("|")), "")]
        base = "en" if lang == "zh" else lang
        x = self.r.random()
        if kind == "name":
            after = self.pick(AFTER_NAME[base].split("|"))
            y = self.r.random()
            if y < 0.3:  # a signature or an entry: the line ends with the name
                after = self.pick(["\n", "\n\n", "\n", "", " "])
            elif y < 0.42:
                after = self.pick([", ", ", ", " "]) + self.words(base, 4) + self.pick([".", ",", ""])
            if base != "ru" and x < 0.25:  # people of other languages are written about too
                base = self.pick(list(GIVEN)[:-1])
            if x < 0.3:  # no announcement: the name opens a line or stands in it
                before = self.pick(["", "", "", self.pick(OPENERS[base].split()) + " " + self.words(base, 3) + self.pick([", ", " – ", ": "]), f"{self.digits('##')}. ", f"{self.words(base, 2)} | "])
                if self.r.random() < 0.3:
                    after = self.pick([" | ", " ", ": "]) + self.words(base, 4)
                elif self.r.random() < 0.2:
                    after = " " + self.words(base, 5) + "."
                return [(before, ""), (self.name(base, False), "name"), (after, "")]
            label = self.pick([w for w in LABELS["name"].split("|") if ("А" <= w[0] <= "я") == (lang == "ru")])
            return [(label, ""), (self.name(base, bool(_TITLED.search(label)) and self.r.random() < 0.65), "name"), (after, "")]
        v = self.value(kind, lang)
        if x < 0.72 or kind == "id_number":
            labels = LABELS[kind].split("|")
            before = self.pick(labels)
            if lang in ("ru", "zh") and self.r.random() < 0.6:
                before = self.pick([w for w in labels if w and (ord(w[0]) > 0x400)] or labels)
        else:
            before = self.pick(["", "", "(", f"{self.place(base)}, ", self.words(base, 3) + ": ", f"{self.digits('##')}. {self.words(base, 2)} | "])
        after = self.pick([".", "", "", ",", ")", f" {self.words(base, 3)}.", f", {self.place(base)}.", " | ", " 。" if lang == "zh" else ".", f" in {self.place(base)}."])
        return [(before, ""), (v, kind), (after, "")]

    def text(self, size: int) -> tuple[str, list[int]]:
        """At least ``size`` characters of one language and, for each, 0 or 1 + the number of its kind."""
        lang = self.pick(["en", "en", "en", "en", "de", "de", "fr", "es", "pt", "it", "nl", "ru", "ru", "zh"])
        out, tags = "", []
        while len(out) < size:
            pieces = self.background(lang) if self.r.random() < 0.55 else self.statement(lang)
            if pieces[0][0] and pieces[0][0][0].islower() and (not out or out[-1] == "\n"):
                pieces[0] = (pieces[0][0].capitalize() if self.r.random() < 0.7 and pieces[0][1] == "" and "@" not in pieces[0][0] else pieces[0][0], pieces[0][1])
            for t, kind in [*pieces, (self.pick([" ", " ", "\n", "\n\n", " "]), "")]:
                out += t
                tags += [KINDS.index(kind) + 1 if kind else 0] * len(t)
        return out, tags
