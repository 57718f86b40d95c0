"""Plain paragraphs, written for these tests, in the four languages of the tables and in others."""

KNOWN = {
    "en": [
        "The council decided on Tuesday that the old bridge over the river will be closed for three months, because engineers found cracks in two of its pillars. Drivers have to take the longer road through the valley until the work is finished.",
        "My grandmother kept bees behind the house, and every autumn she gave a jar of honey to each of the neighbours. She said that a garden without bees was like a kitchen without a stove, and nobody dared to disagree.",
        "Before you assemble the shelf, check that all the screws listed on the first page are in the bag. Lay the two long boards on a soft surface, fasten the brackets loosely, and tighten them only when the frame stands straight.",
        "Scientists have measured how quickly the glacier loses ice by comparing photographs taken from the same place over forty years. Their results suggest that most of the lower part could be gone before the end of the century.",
        "The match ended in a draw after the visitors scored in the last minute. Both coaches were satisfied with the result, although the home side had missed a penalty and several good chances during the second half.",
        "He opened the letter slowly, read it twice and put it back on the table. Outside, the rain had stopped and children were shouting in the street, but he heard nothing of that and went on staring at the wall.",
    ],
    "de": [
        "Der Stadtrat hat am Dienstag beschlossen, dass die alte Brücke über den Fluss für drei Monate gesperrt wird, weil an zwei Pfeilern Risse gefunden wurden. Autofahrer müssen bis zum Ende der Arbeiten die längere Straße durch das Tal nehmen.",
        "Meine Großmutter hielt hinter dem Haus Bienen, und jeden Herbst schenkte sie allen Nachbarn ein Glas Honig. Sie sagte, ein Garten ohne Bienen sei wie eine Küche ohne Herd, und niemand wagte es, ihr zu widersprechen.",
        "Bevor Sie das Regal aufbauen, prüfen Sie bitte, ob alle Schrauben von der ersten Seite in der Tüte liegen. Legen Sie die beiden langen Bretter auf eine weiche Unterlage und ziehen Sie die Winkel erst fest, wenn der Rahmen gerade steht.",
        "Forscher haben gemessen, wie schnell der Gletscher an Eis verliert, indem sie Fotos verglichen, die vierzig Jahre lang an derselben Stelle aufgenommen wurden. Nach ihren Ergebnissen könnte der untere Teil noch vor dem Ende des Jahrhunderts verschwinden.",
        "Das Spiel endete unentschieden, nachdem die Gäste in der letzten Minute getroffen hatten. Beide Trainer waren mit dem Ergebnis zufrieden, obwohl die Gastgeber einen Elfmeter und mehrere gute Möglichkeiten in der zweiten Hälfte vergeben hatten.",
        "Er öffnete den Brief langsam, las ihn zweimal und legte ihn wieder auf den Tisch. Draußen hatte der Regen aufgehört, und Kinder riefen auf der Straße, aber davon hörte er nichts und starrte weiter an die Wand.",
    ],
    "es": [
        "El ayuntamiento decidió el martes que el puente viejo sobre el río estará cerrado durante tres meses, porque los ingenieros encontraron grietas en dos de los pilares. Los conductores tendrán que tomar la carretera más larga por el valle.",
        "Mi abuela tenía abejas detrás de la casa y cada otoño regalaba un tarro de miel a cada uno de los vecinos. Decía que un jardín sin abejas era como una cocina sin fuego, y nadie se atrevía a contradecirla.",
        "Antes de montar la estantería, compruebe que todos los tornillos de la primera página están en la bolsa. Ponga las dos tablas largas sobre una superficie blanda y apriete las piezas solamente cuando el marco esté recto.",
        "Los científicos han medido con qué rapidez pierde hielo el glaciar comparando fotografías tomadas desde el mismo lugar durante cuarenta años. Sus resultados indican que la parte más baja podría desaparecer antes del final del siglo.",
        "El partido terminó en empate después de que los visitantes marcaran en el último minuto. Los dos entrenadores quedaron contentos con el resultado, aunque el equipo de casa había fallado un penalti y varias ocasiones en la segunda parte.",
        "Abrió la carta despacio, la leyó dos veces y la dejó otra vez sobre la mesa. Fuera había parado de llover y los niños gritaban en la calle, pero él no oía nada de eso y seguía mirando la pared.",
    ],
    "fr": [
        "Le conseil a décidé mardi que le vieux pont sur la rivière sera fermé pendant trois mois, parce que des ingénieurs ont trouvé des fissures dans deux piliers. Les conducteurs devront prendre la route plus longue par la vallée.",
        "Ma grand-mère avait des abeilles derrière la maison, et chaque automne elle donnait un pot de miel à tous les voisins. Elle disait qu'un jardin sans abeilles était comme une cuisine sans feu, et personne n'osait la contredire.",
        "Avant de monter l'étagère, vérifiez que toutes les vis de la première page sont dans le sac. Posez les deux longues planches sur une surface douce et ne serrez les pièces que lorsque le cadre est bien droit.",
        "Des chercheurs ont mesuré à quelle vitesse le glacier perd de la glace en comparant des photographies prises au même endroit pendant quarante ans. Leurs résultats montrent que la partie basse pourrait disparaître avant la fin du siècle.",
        "Le match s'est terminé par un nul après que les visiteurs ont marqué dans la dernière minute. Les deux entraîneurs étaient contents du résultat, même si l'équipe de la maison avait manqué un penalty et plusieurs occasions.",
        "Il ouvrit la lettre lentement, la lut deux fois et la remit sur la table. Dehors, la pluie avait cessé et des enfants criaient dans la rue, mais il n'entendait rien de tout cela et continuait à regarder le mur.",
    ],
}

FOREIGN = {
    "it": [
        "Il consiglio ha deciso martedì che il vecchio ponte sul fiume resterà chiuso per tre mesi, perché gli ingegneri hanno trovato crepe in due pilastri. Gli automobilisti dovranno prendere la strada più lunga attraverso la valle.",
        "Mia nonna teneva le api dietro casa e ogni autunno regalava un vasetto di miele a ciascuno dei vicini. Diceva che un giardino senza api era come una cucina senza fuoco, e nessuno osava contraddirla.",
    ],
    "nl": [
        "De gemeenteraad heeft dinsdag besloten dat de oude brug over de rivier drie maanden gesloten wordt, omdat er scheuren in twee pijlers zijn gevonden. Automobilisten moeten tot het einde van het werk de langere weg door het dal nemen.",
        "Mijn grootmoeder hield bijen achter het huis en elk najaar gaf ze een pot honing aan alle buren. Ze zei dat een tuin zonder bijen als een keuken zonder fornuis was, en niemand durfde haar tegen te spreken.",
    ],
    "sv": [
        "Kommunen beslutade på tisdagen att den gamla bron över ån ska vara stängd i tre månader, eftersom ingenjörer hittade sprickor i två av pelarna. Bilister får ta den längre vägen genom dalen tills arbetet är klart.",
        "Min mormor hade bin bakom huset och varje höst gav hon en burk honung till alla grannar. Hon sade att en trädgård utan bin var som ett kök utan spis, och ingen vågade säga emot henne.",
    ],
    "pl": [
        "Rada miasta zdecydowała we wtorek, że stary most na rzece zostanie zamknięty na trzy miesiące, ponieważ inżynierowie znaleźli pęknięcia w dwóch filarach. Kierowcy będą musieli jechać dłuższą drogą przez dolinę.",
        "Moja babcia trzymała pszczoły za domem i każdej jesieni dawała słoik miodu wszystkim sąsiadom. Mówiła, że ogród bez pszczół jest jak kuchnia bez pieca, i nikt nie śmiał się jej sprzeciwić.",
    ],
    "fi": [
        "Kaupunginvaltuusto päätti tiistaina, että joen ylittävä vanha silta suljetaan kolmeksi kuukaudeksi, koska kahdesta pilarista löytyi halkeamia. Autoilijoiden on ajettava pidempää tietä laakson läpi, kunnes työt ovat valmiit.",
        "Isoäidilläni oli mehiläisiä talon takana, ja joka syksy hän antoi purkin hunajaa kaikille naapureille. Hän sanoi, että puutarha ilman mehiläisiä on kuin keittiö ilman liettä, eikä kukaan uskaltanut väittää vastaan.",
    ],
    "tr": [
        "Belediye meclisi salı günü nehrin üzerindeki eski köprünün üç ay boyunca kapatılmasına karar verdi, çünkü mühendisler iki ayakta çatlaklar buldu. Sürücüler işler bitene kadar vadiden geçen daha uzun yolu kullanacak.",
        "Büyükannem evin arkasında arı beslerdi ve her sonbaharda bütün komşulara bir kavanoz bal verirdi. Arısız bir bahçenin ocaksız bir mutfağa benzediğini söylerdi ve kimse ona karşı çıkmaya cesaret edemezdi.",
    ],
    "ru": [
        "Городской совет решил во вторник, что старый мост через реку будет закрыт на три месяца, потому что инженеры нашли трещины в двух опорах. Водителям придётся ехать по более длинной дороге через долину.",
        "Моя бабушка держала пчёл за домом и каждую осень дарила банку мёда всем соседям. Она говорила, что сад без пчёл похож на кухню без печи, и никто не смел с ней спорить.",
    ],
    "code": [
        "def merge(a, b):\n    out, i, j = [], 0, 0\n    while i < len(a) and j < len(b):\n        if a[i] <= b[j]:\n            out.append(a[i]); i += 1\n        else:\n            out.append(b[j]); j += 1\n    return out + a[i:] + b[j:]\n",
        "for (int k = 0; k < n; k++) { sum += v[k] * w[k]; if (sum > max) { max = sum; idx = k; } } printf(\"%d %f\\n\", idx, max); free(v); free(w); return idx;",
    ],
    "noise": [
        "zzqx wvk jjhh pqz xxk vvb qjw zxcvb kkjq wqx pfz hgj vbnk qwx zkj xqv jjw kzx bvq hjx wkq zpx qqv jkx vwz xjq kqz",
        "A7f9 x0Q2 kD83 pW11 zz9K Lm4T q8Rb 77Hn vC2x J0pL s5Yt 9dKe Xq3U wB6m N8zG r1Fh tt4V cP7j yE2a Ku5i oZ9s 3gWl bM6x",
    ],
}
